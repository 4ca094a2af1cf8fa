import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codelattice.model import ENTRY
from codelattice.sources import entries as es
from codelattice.sources import kzip, wire


@given(st.lists(st.binary(max_size=300)))
def test_delimited_records_come_back(records):
    assert list(wire.records(b"".join(map(wire.delimited, records)))) == records


def test_broken_streams():
    for bad in (b"\x05ab", b"\x80"):
        with pytest.raises(wire.WireError):
            list(wire.records(bad))


V = ("s", "c", "r", "p", "l")
ROWS = [(V, "", None, "/f", bytearray(b"\xff\x00")), (V, "/e", ("t", "", "", "é", ""), "/", bytearray())]


def plain(df):
    return sorted((tuple(r.source), r.edge_kind, tuple(r.target) if r.target else None, r.fact_name, bytes(r.fact_value)) for r in df.collect())


def test_delimited_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, ENTRY).repartition(2)
    es.write_delimited(df, str(tmp_path / "out"))
    assert plain(es.read_delimited(spark, str(tmp_path / "out"))) == plain(df)


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame(ROWS, ENTRY)
    es.to_json(df).write.text(str(tmp_path / "json"))
    assert plain(es.read_json(spark, str(tmp_path / "json"))) == plain(df)


def test_textproto(spark):
    lines = {r.value for r in es.textproto(spark.createDataFrame(ROWS[1:], ENTRY)).collect()}
    assert lines == {'source { signature: "s" corpus: "c" root: "r" path: "p" language: "l" } edge_kind: "/e" target { signature: "t" path: "é" } fact_name: "/"'}


def test_directory(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.c").write_text("int x;")
    df = es.files_to_entries(spark, str(tmp_path / "in"), [{"pattern": "a/(.*)", "corpus": "A", "path": "@1@"}])
    assert {(r.source.corpus, r.source.path, r.fact_name, bytes(r.fact_value)) for r in df.collect()} == {("A", "x.c", "/graph/node/kind", b"file"), ("A", "x.c", "/graph/text", b"int x;"), ("A", "x.c", "/graph/text/encoding", b"UTF-8")}


def test_archives(spark, tmp_path):
    unit = {"unit": {"v_name": {"corpus": "c", "language": "go"}, "source_file": ["m.go"], "required_input": [{"info": {"path": "m.go", "digest": "d1"}}]}}
    for name in ("a.kzip", "b.kzip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("root/units/u1", json.dumps(unit))
            z.writestr("root/files/d1", b"package m")
    units, inputs = kzip.read_units(spark, str(tmp_path)), kzip.read_inputs(spark, str(tmp_path))
    assert units.count() == 2 and kzip.merged(units).count() == 1
    assert {(r.unit, r.path, r.digest) for r in inputs.collect()} == {("u1", "m.go", "d1")}
    assert kzip.find(units, sources=["^m"], languages=["go"]).count() == 2 and kzip.find(units, sources=["z"]).count() == 0
    assert kzip.wrong_digests(kzip.read_files(spark, str(tmp_path))).count() == 2
    assert kzip.by_digest_or_language(units, inputs, languages=["go"])[1].count() == 2
    with pytest.raises(ValueError):
        kzip.by_digest_or_language(units, inputs)


def test_generated_code_rules(spark):
    from codelattice.sources import metadata

    files = spark.createDataFrame([("f", '{"type": "m", "meta": [{"type": "nop"}, {"type": "anchor_defines", "begin": 1, "end": 4, "edge": "%/graph/edge/generates", "vname": {"signature": "s", "corpus": "c", "root": "", "path": "", "language": ""}}]}'), ("g", "{broken")], "file string, text string")
    rules = metadata.rules(files)
    assert [(r.file, r.begin, r.end, r.kind, r.reverse) for r in rules.collect()] == [("f", 1, 4, "/graph/edge/generates", True)]
    anchors = spark.createDataFrame([("a", "f", 1, 4), ("b", "f", 1, 5)], "anchor string, file string, start int, end int")
    refs = spark.createDataFrame([("a", "/graph/edge/defines/binding", "n"), ("b", "/graph/edge/defines", "m")], "anchor string, kind string, target string")
    assert [tuple(r) for r in metadata.edges(rules, anchors, refs).collect()] == [("graph://c#s", "/graph/edge/generates", "n")]


def test_archives_written_and_tar(spark, tmp_path):
    import io
    import tarfile

    units = spark.createDataFrame([("a.kzip", "u1", json.dumps({"unit": {"v_name": {"language": "go"}}})), ("b.kzip", "u2", '{"unit": {}}')], "archive string, digest string, record string")
    files = spark.createDataFrame([("a.kzip", bytearray(b"x")), ("a.kzip", bytearray(b"x")), ("b.kzip", bytearray(b""))], "archive string, content binary")
    (tmp_path / "z").mkdir()
    for r in kzip.archives(units, files).collect():
        (tmp_path / "z" / r.archive).write_bytes(bytes(r.content))
    assert {(u.digest, u.language) for u in kzip.read_units(spark, str(tmp_path / "z")).collect()} == {("u1", "go"), ("u2", "")}
    back = kzip.read_files(spark, str(tmp_path / "z"))
    assert back.count() == 2 and kzip.wrong_digests(back).count() == 0
    (tmp_path / "t").mkdir()
    with tarfile.open(tmp_path / "t" / "c.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/e.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert [(r.name, bytes(r.content)) for r in kzip.read_members(spark, str(tmp_path / "t")).collect()] == [("d/e.txt", b"hi")]


def test_a_name_is_encoded_once_and_records_are_those_of_single_entries(spark, monkeypatch):
    from codelattice.model import ENTRY
    from codelattice.sources import entries, wire

    n, m = ("é", "c", "", "p" * 200, "x"), ("", "", "", "", "")
    rows = [(n, "", None, "/f", b"v" * 300), (n, "", None, "/g", b""), (n, "/e", m, "/", b""), (m, "/e", n, "/", b"")] * 3
    df = spark.createDataFrame(rows, ENTRY).coalesce(1)
    got = entries.encoded(df)
    as_dict = lambda v: v and dict(zip(wire.FIELDS, v, strict=True))
    want = [wire.delimited(wire.encode_entry({"source": as_dict(s), "edge_kind": k, "target": as_dict(t), "fact_name": f, "fact_value": x})) for s, k, t, f, x in rows]
    assert sorted(bytes(r.record) for r in got.collect()) == sorted(want)
    assert sorted(map(str, entries.decoded(got).collect())) == sorted(map(str, df.collect()))
    calls, real = [], wire.encode_vname
    monkeypatch.setattr(wire, "encode_vname", lambda v: calls.append(v) or real(v))
    names = wire.Names()
    assert len({names.encode(n) for _ in range(5)}) == 1 and len(calls) == 1
