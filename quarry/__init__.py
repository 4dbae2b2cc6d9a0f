"""quarry: turn semi-structured text into Spark tables and search them.

Three independent parts, all expressed as DataFrame / Column functions:

* document search - HTML to words, overlapping word chunks, a keyword (BM25)
  index and an exact vector index kept as ordinary tables, keyword / vector /
  hybrid queries in single or batch form (``quarry.operators``);
* deal-message extraction - one structured row per tranche of a bond
  new-issue announcement (``quarry.operators.deals``, ``quarry.operators.layouts``);
* token tagging - a BIO tagger trained and applied with Spark MLlib
  (``quarry.operators.tagging``).
"""

from quarry.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
