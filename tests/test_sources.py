from __future__ import annotations

import gzip

import pytest

from helixframe.functions.bases import text_as_bases
from helixframe.operators import evaluate, graph
from helixframe.plans import catalog, cli
from helixframe.sources import binary_track, database, sequences
from tests.test_graph import SEQ, as_dict, frame

K = 9


def test_fasta_comments_may_hold_marks(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as out:
        out.write(">one a T>A change\nACGT\nAC\r\n>two\nGG\n\n>three x\n")
    rows = sequences.read_fasta(spark, str(tmp_path / "a.fa.gz")).orderBy("seq_pos").collect()
    assert [(r.header, r.comment, r.sequence) for r in rows] == [("one", "a T>A change", "ACGTAC"), ("two", None, "GG"), ("three", "x", "")]


def test_fastq_quality_may_start_like_a_header(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\n+\n@!!!\n@r2\nGGA\n+r2\n!\n")
    rows = sequences.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("seq_pos").collect()
    assert [(r.header, r.sequence) for r in rows] == [("r1", "ACGT"), ("r2", "GGA")]


def test_gfa_paths(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("H\tVN:Z:1.2\nS\tx\tAACG\nS\ty\tGGT\nP\tp\tx+,y-\t*\n")
    rows = sequences.read_assembly(spark, str(tmp_path / "a.gfa")).orderBy("segment_id").collect()
    assert [(r.path, r.abs_start, r.seq) for r in rows] == [("p", 0, "AACG"), ("p", 4, "ACC")]


def test_bed_and_coordinates(spark, tmp_path):
    (tmp_path / "a.bed").write_text("x\t1\t5\n# no\nz 2 3\n")
    assert sequences.read_bed(spark, str(tmp_path / "a.bed")).count() == 2
    assert tuple(sequences.parse_coordinate(spark, "a:b:3-9").first()) == ("a:b", 3, 9)


def test_database_keeps_k(spark, tmp_path):
    d = graph.build(frame(spark, [SEQ]), K)
    database.save(d, str(tmp_path / "a"), K)
    database.save(d, str(tmp_path / "b"), K + 1)
    found, k = database.load(spark, str(tmp_path / "a"))
    assert k == K and as_dict(found) == as_dict(d)
    with pytest.raises(ValueError):
        database.load_same_k(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_binary_track_roundtrip(spark, tmp_path):
    rows = evaluate.track(frame(spark, [SEQ, SEQ[:30] + "NN" + SEQ[50:]]), graph.build(frame(spark, [SEQ]), K), K, whole=True)
    binary_track.write_binary_track(rows, str(tmp_path / "t.bkwig"), K)
    back = binary_track.read_binary_track(spark, str(tmp_path / "t.bkwig")).drop("k")
    assert back.exceptAll(rows.select(back.columns)).count() == 0 and back.count() == rows.count()


def test_text_as_bases(spark):
    d = spark.createDataFrame([("Ab c-é1",), (None,)], "t string")
    assert [r[0] for r in d.select(text_as_bases(d.t)).collect()] == ["ACGNNN", None]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(f">s\n{SEQ}\n")
    db, track = str(tmp_path / "d.helix"), str(tmp_path / "t.bkwig")
    assert cli.main(["validate", "-r", str(tmp_path / "a.fa"), "-k", "9", "-o", db], spark) == 0
    assert cli.main(["validate", "-f", str(tmp_path / "a.fa"), "-d", db, "-o", track], spark) == 0
    assert "inf" in capsys.readouterr().out
    assert cli.main(["lookup", "-i", track, "s:3-6"], spark) == 0
    assert "s:3-6" in capsys.readouterr().out
    assert cli.main(["lookup", "-i", track, "z:3-6"], spark) == 1
    assert cli.main(["union", "-d", db, db], spark) == 0
    assert cli.main(["subgraph", "-d", db, "-f", str(tmp_path / "a.fa"), "-o", str(tmp_path / "g.gfa")], spark) == 0
    assert (tmp_path / "g.gfa").read_text().startswith("H\t")


def test_streaming_equals_batch(spark, tmp_path):
    from helixframe.streaming.ingest import ingest

    for i, part in enumerate((SEQ[:60], SEQ[40:])):
        frame(spark, [part]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("header string, sequence string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert as_dict(ingest(stream, str(tmp_path / "out"), K)) == as_dict(graph.build(frame(spark, [SEQ[:60], SEQ[40:]]), K))


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_second_version_of_graph_files(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("H\tVN:Z:2.0\nS\tx\t4\tAACG\nS\ty\t3\tGGT\nE\t*\tx+\ty-\t4$\t4$\t3$\t3$\t0M\nO\tp\tx+ y-\n")
    rows = sequences.read_assembly(spark, str(tmp_path / "a.gfa")).orderBy("segment_id").collect()
    assert [(r.path, r.abs_start, r.seq) for r in rows] == [("p", 0, "AACG"), ("p", 4, "ACC")]


def test_packed_and_distributed_outputs(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(f">s\n{SEQ}\n")
    fa, db = str(tmp_path / "a.fa"), str(tmp_path / "d.helix")
    assert cli.main(["validate", "-r", fa, "-k", "9", "-o", db], spark) == 0
    assert cli.main(["validate", "-f", fa, "-d", db, "-o", str(tmp_path / "t.bed")], spark) == 0
    assert cli.main(["validate", "-f", fa, "-d", db, "-o", str(tmp_path / "parts.bed"), "--parts"], spark) == 0
    whole = (tmp_path / "t.bed").read_text()
    assert whole == "".join(p.read_text() for p in sorted((tmp_path / "parts.bed").glob("part-*"))) and whole.count("\n") == len(SEQ)
    capsys.readouterr()
    for name in ("g.gfa2.gz", "g.gfa2"):
        assert cli.main(["subgraph", "-d", db, "-f", fa, "-o", str(tmp_path / name)], spark) == 0
    packed = gzip.open(tmp_path / "g.gfa2.gz", "rt").read()
    assert packed == (tmp_path / "g.gfa2").read_text() and packed.startswith("H\tVN:Z:2.0\nS\t")
    summary = capsys.readouterr().out.split("DBG Summary statistics:")[0].splitlines()
    assert len(summary) == 6 + 44 and "# segments: 1" in summary and "# dead ends: 2" in summary


def test_windows_over_chunks(spark, monkeypatch):
    """Chunked frames and binned joins give what one frame and one join would."""
    from helixframe.operators import tracks

    d = graph.build(frame(spark, [SEQ, SEQ[20:60]]), K)
    rows = evaluate.track(frame(spark, [SEQ, SEQ[5:100]]), d, K, whole=True).cache()
    wanted = spark.createDataFrame([("s0", 3, 70), ("s1", 10, 12), ("s0", 100, 1 << 50)], "header string, begin long, end long")

    def results():
        frames = tracks.covering(rows, K), evaluate.support_ahead(rows, K).select("path", "pos", "score"), tracks.lookup(rows, wanted), evaluate.in_intervals(rows, wanted)
        return [sorted(map(repr, f.collect())) for f in frames]

    plain = results()
    for module, name in ((tracks, "CHUNK"), (evaluate, "BIN")):
        monkeypatch.setattr(module, name, 16)
    assert results() == plain and all(plain)
