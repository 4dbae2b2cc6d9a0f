import gzip
import io
import os
import random

from quarry.llm.warc import MAGIC, archive_round_trip, member, parse, payload_digest, read_archives, record, records_in_range, write_archives


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at: at + n]


def test_any_cut_reads_every_record_once():
    rnd = random.Random(2)
    data, starts = b"", []
    for i in range(60):
        starts.append(len(data))
        body = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 10, 3000]))) + MAGIC * rnd.randrange(3) + b"x" * rnd.choice([0, 200_000])
        data += member(record(i, f"http://h/{i}", body, payload_digest(body), len(body), None, str(i)))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= 60
    for step in (37, 1000, 70_001, len(data)):
        got = [at for a in range(0, len(data), step) for at, _ in records_in_range(Bytes(data), len(data), a, min(a + step, len(data)))]
        assert got == starts
    # magic bytes that start no record are passed over
    noise = MAGIC + os.urandom(50) + gzip.compress(b"not a record") + data
    assert len(list(records_in_range(Bytes(noise), len(noise), 0, len(noise)))) == 60


def test_header_round_trip():
    head, body = parse(record(5, "http://x/\r\ny: z", "é".encode(), "D", 2, None, "u"))
    assert head["WARC-Target-URI"] == "http://x/%0D%0Ay: z" and body == "é".encode() and head["Page-ID"] == "5"


def test_round_trip_with_odd_rows(spark, tmp_path):
    html = [None, "", "a", "a", "é" * 100_000, "a", "\x1f\x8b", None]
    rows = [(i, f"u{i}", h, "p") for i, h in enumerate(html)] + [(2, "u2", "a", "p"), (None, None, "a", "p"), (None, "n", "alone", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    manifest = write_archives(pages, str(tmp_path))
    out = read_archives(manifest, range_bytes=100).collect()
    assert len(out) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in out}
    for i, u, h, _ in rows:
        r, p = by[i, u], (h or "").encode()
        same = [a for a, _, b, _ in rows if (b or "") == (h or "") and a is not None]
        first = min(same) if same else None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), payload_digest(p))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["payload"] == (p if i == first else None)
    assert archive_round_trip(pages.limit(0)).count() == 0
