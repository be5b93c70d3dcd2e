"""A growing index keeps each text once and deals its statistics packed."""

from pyspark.sql import functions as F

from lexmere.operators import counting, segments
from lexmere.operators import terms as terms_module
from lexmere.operators.segments import GrowingIndex
from tests.test_search import corpus, frame


def test_segments_hold_texts_and_statistics_only(spark, tmp_path, monkeypatch):
    """no copy of the texts, no forward index; statistics of any batch size merge."""
    names = []
    plain_written = segments.written
    monkeypatch.setattr(segments, "written", lambda df, name, *rest: names.append(name) or plain_written(df, name, *rest))
    monkeypatch.setattr(counting, "LIST_CHUNK", 400)
    monkeypatch.setattr(counting, "STATS_ROWS", 30)
    monkeypatch.setattr(segments, "MERGED_BYTES", 500)
    texts = corpus(33, 40)
    growing = GrowingIndex.create(spark, str(tmp_path / "index"))
    for part in range(2):
        growing.append(frame(spark, {k: t for i, (k, t) in enumerate(texts.items()) if i % 2 == part}).repartition(3))
    growing.append(frame(spark, {"none": "x"}).filter("false"))
    assert not names
    manifest = growing.manifest()
    held = {p.name for s in manifest["segments"] for p in (tmp_path / "index" / s).iterdir()}
    assert held == {"chunks", "stats"} and manifest["n_docs"] == 40
    docs = [r.doc for r in growing._read(manifest["segments"], "chunks").collect()]
    assert len(set(docs)) == 40 and max(d >> segments.PART_BITS for d in docs) < manifest["parts"]

    def check(live):
        rows = terms_module.array_rows(terms_module.term_arrays(live, "text", terms_module.TermOptions(), ["doc"]))
        want = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), F.bit_xor("doc").alias("docs"))
        got = growing._merged(growing.manifest())
        assert sorted(map(tuple, got.select("term", "df", "cf", "docs").collect())) == sorted(map(tuple, want.collect()))

    check(growing._read(manifest["segments"], "chunks"))
    assert growing.delete(spark.createDataFrame([("d01",), ("d08",), ("d08",)], "chunk_id string")) == 2
    live = growing._live(growing.manifest(), "chunks")
    assert live.count() == 38
    check(live)
    growing.compact()
    check(growing._read(growing.manifest()["segments"], "chunks"))
    opened = growing.open()
    assert opened.forward is None and opened.texts.count() == 38


def test_an_older_manifest_grows_on(spark, tmp_path):
    """Numbers of segments written before, by version and place, are not used again."""
    growing = GrowingIndex.create(spark, str(tmp_path / "index"))
    growing.append(frame(spark, corpus(3, 5)))
    growing._publish({k: v for k, v in growing.manifest().items() if k != "parts"} | {"version": 7})
    growing.append(frame(spark, corpus(4, 5)))
    rows = growing._read(growing.manifest()["segments"], "chunks")
    older = 7 << segments.OLDER_BITS | (1 << segments.OLDER_BITS) - 1  # the last number of that version
    assert rows.select("doc").distinct().count() == 14 and sum(r.doc > older for r in rows.collect()) == 7
