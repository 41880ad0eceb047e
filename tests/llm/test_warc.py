import base64
import hashlib

import pytest

from tessera.llm import warc


def pages(spark):
    big = "<p>" + "x" * 100_000 + "</p>"
    rows = [(3, "http://a/\nb", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://a/4", ""), (5, "http://a/5%", big), (6, "http://a/6", "é😀"), (1, "http://a/1", "same"), (None, "http://a/n", "same")]
    return spark.createDataFrame([(*r, "d", "f") for r in rows], "page_id long, url string, html string, digest string, first string")


def test_round_trip(spark):
    df = pages(spark)
    folder = warc.new_folder(df)
    index = warc.write_archives(df, folder, archive_bytes=300)
    assert index.count() == df.count() and index.select("file").distinct().count() > 1
    got = warc.read_records(index, folder).collect()
    texts = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len(got) == 8
    for r in got:
        full = texts[r.page_id]
        assert r.payload_bytes == len(full) and r.payload_digest == base64.b32encode(hashlib.sha1(full).digest()).decode()
        assert (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, full)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None), (6, "response", None)]
    urls = {r.page_id: r.url for r in index.collect()}
    assert urls[3] == "http://a/\nb"


def test_small_payloads_and_selections(spark):
    df = pages(spark)
    folder = warc.new_folder(df)
    index = warc.write_archives(df, folder, min_revisit_bytes=1)
    got = warc.read_records(index.where("page_id in (3, 4)"), folder).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(3, "revisit"), (4, "response")]
    assert warc.read_records(index.where("false"), folder).count() == 0
    none = warc.new_folder(df)
    assert warc.write_archives(df.where("false"), none).count() == 0


def test_a_damaged_record_is_found(spark):
    df = pages(spark).where("page_id = 5")
    folder = warc.new_folder(df)
    index = warc.write_archives(df, folder)
    row = index.first()
    fs, base = warc.open_fs(folder)
    data = bytearray(fs.open_input_file(f"{base}/{row.file}").readall())
    fields, block = warc.parse(__import__("zlib").decompress(bytes(data[row.offset :]), 31))
    wrong = warc.member(warc.record([(k, v) for k, v in (("WARC-Type", "response"), ("WARC-Record-ID", fields["warc-record-id"]), ("WARC-Payload-Digest", fields["warc-payload-digest"]))], block.replace(b"xxxx", b"yyyy", 1)))
    with fs.open_output_stream(f"{base}/{row.file}", compression=None) as out:
        out.write(bytes(data[: row.offset]) + wrong)
    moved = spark.createDataFrame([(row.file, row.offset, len(wrong))], "file string, offset long, length long")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(moved, folder).collect()
