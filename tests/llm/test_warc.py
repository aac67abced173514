import io

import zstandard

from caseflow.llm import warc as A


def archive(records):
    class Sink(io.BytesIO):
        def close(self):
            pass
    out = Sink()
    w = A.ArchiveWriter(out)
    for r in records:
        w.add(r)
    w.close()
    return out.getvalue()


def make(i, payload):
    return A.record(i, f"http://h/{i}", payload, len(payload), A.digest(payload), None, False, A.DATE)


def test_every_record_is_a_frame_and_the_dictionary_leads():
    import struct
    payloads = [(f"<html><body><p>page number {i} with words {i * 7} and more of them</p></body></html>" * 5).encode()
                for i in range(300)]
    data = archive([make(i, p) for i, p in enumerate(payloads)])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == A.DICT_MAGIC
    words = zstandard.ZstdCompressionDict(data[8:8 + size])
    # the first frame after the dictionary is one whole record
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size:])
    assert first == make(0, payloads[0])
    got = [block.partition(b"\r\n\r\n")[2] for _, block in A.read_archive(io.BytesIO(data))]
    assert got == payloads


def test_small_archives_without_a_dictionary():
    for records in ([], [make(1, b"")], [make(1, b"x"), make(2, b"y" * 3_000_000)]):
        got = list(A.read_archive(io.BytesIO(archive(records))))
        assert len(got) == len(records)


def test_round_trip_nulls_ties_and_extra_columns(spark, tmp_path):
    rows = [(1, "http://a/ x\r\ny", "héllo\r\n\r\n", 0), (2, None, "héllo\r\n\r\n", 0), (3, "u", None, 0), (4, "u", "", 0),
            (None, "u", "only", 0), (None, "u", "héllo\r\n\r\n", 0), (1, "http://a", "héllo\r\n\r\n", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    m = A.write_archives(df, str(tmp_path / "warc"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in A.read_archives(m).collect()),
                 key=str)
    h = "héllo\r\n\r\n".encode()
    assert got == sorted([(1, "response", None, len(h), bytearray(h)), (2, "revisit", 1, len(h), None),
                          (3, "response", None, 0, bytearray()), (4, "revisit", 3, 0, None),
                          (None, "response", None, 4, bytearray(b"only")), (None, "revisit", 1, len(h), None),
                          (1, "response", None, len(h), bytearray(h))], key=str)
    m = A.write_archives(df.limit(0), str(tmp_path / "none"))
    assert m.count() == 0 and A.read_archives(m).count() == 0
