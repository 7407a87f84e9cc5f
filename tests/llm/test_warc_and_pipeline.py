import gzip
import hashlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewgraph.llm import warc
from reviewgraph.llm.store import bucketed, release, session_folder, shared_folder, stored

BIG = "naïve 😀 " * 20_000
HTML = [(1, "u", "a" * 150), (2, "u", "a" * 150), (3, "v", "short"), (4, "v", "short"),
        (5, None, None), (6, "x", ""), (7, "x", BIG), (8, "x", BIG + "!"), (0, "x", BIG),
        (9, "x\r\ny", "WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 20),
        (10, "z", "é" * 50), (11, "z", "é" * 50), (12, "z", "é" * 49 + "a"),
        (2, "u", "a" * 150), (20, "q", "b" * 100), (20, "q", "b" * 100), (None, "n", "b" * 100)]
SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark, rows=HTML):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)


def expected():
    raw = [(i, (h or "").encode()) for i, _, h in HTML]
    first = {}
    for i, b in raw:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in raw:
        to = first.get(b) if len(b) >= 100 else None
        again = to is not None and to != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                    to if again else None))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    got = warc.archived_and_read(pages(spark)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                    r["refers_to"]) for r in got), key=str) == expected()
    assert all(r["complete"] for r in got)
    whole = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert whole[0] == BIG.encode() and whole[8] == (BIG + "!").encode() and whole[5] == b""


def test_segments_are_numbered_and_can_be_lost(spark):
    data = warc.page_records(1, "u", BIG.encode(), None, "one", segment=50_000)
    records = list(warc.parse_records(io.BytesIO(data)))
    assert len(records) > 3
    assert [h.get("warc-segment-number") for h, _ in records] == [
        str(k + 1) for k in range(len(records))]
    total = int(records[-1][0]["warc-segment-total-length"])
    assert total == sum(len(b) for _, b in records)
    rows = [warc._fields(h, b) for h, b in records]
    kinds = warc.RECORDS
    for lost, sound in ((None, True), (0, False), (1, False), (len(rows) - 1, False)):
        left = [r for k, r in enumerate(rows) if k != lost][::-1]
        got = warc.reassembled(spark.createDataFrame(left, kinds)).collect()
        assert [r["complete"] for r in got] == [sound]
        assert (got[0]["payload"] == BIG.encode()) == sound
        assert got[0]["page_id"] == (None if lost == 0 else 1)


def test_archives_are_plain_warc_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(pages(spark), path)
    heads = []
    for file in (tmp_path / "archive").glob("part-*"):
        for headers, _ in warc.parse_records(io.BytesIO(gzip.decompress(file.read_bytes()))):
            heads.append(headers)
    assert len({h["warc-record-id"] for h in heads}) == len(heads)
    assert sum(h["warc-type"] != "continuation" for h in heads) == len(HTML)
    assert all("warc-profile" in h for h in heads if h["warc-type"] == "revisit")


def test_chunked_framing():
    for payload in (b"", b"a", "é".encode() * 5000, b"0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for unsound in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(unsound)


def test_no_pages(spark):
    assert warc.archived_and_read(pages(spark, [])).collect() == []


def test_intermediate_tables_are_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(base)
    rows = stored(spark.range(5))
    assert base.rsplit("/", 1)[-1] in rows.inputFiles()[0] and rows.count() == 5


def test_release_deletes_folders_and_tables(spark):
    """Afterwards neither files nor tables of the session are left; new ones can be written."""
    stored(spark.range(5))
    rows = bucketed(spark.range(9).withColumnRenamed("id", "doc_id"), "doc_id")
    assert rows.count() == 9
    folder = Path(session_folder(spark).removeprefix("file:"))
    assert len(list(folder.iterdir())) >= 2
    release(spark)
    assert not folder.exists()
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("llm_")]
    release(spark)
    assert stored(spark.range(3)).count() == 3


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two languages, a copy, a near copy, a leak, a repeated line, odd rows."""
    import random

    rng = random.Random(9)
    words = {"en": [f"the{i}th" for i in range(400)], "de": [f"sch{i}ung" for i in range(400)]}
    item = " ".join(f"benchmark{i}" for i in range(30))
    line = "a line that stands in many of the documents"
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append([i, "\n".join(" ".join(rng.choice(words[lang]) for _ in range(20))
                                  for _ in range(5)), lang])
    rows[10][1] = rows[4][1]
    rows[12][1] = rows[6][1].replace(rows[6][1].split(" ")[3], "changed", 1)
    rows[20][1] += " " + item
    for i in (30, 31, 32):
        rows[i][1] += "\n" + line
    rows += [[70, None, "en"], [71, "", "de"], [72, "123 456", "en"], [None, rows[1][1], None]]
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, lang, None, len(t or ""), "kept") for i, t, lang in rows]
    spark.createDataFrame(docs, DOCUMENTS).repartition(3).write.parquet(
        str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(
        str(folder / "benchmark.parquet"))
    return str(folder), rows, line


def test_stages_take_effect(spark, corpus):
    folder, rows, line = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == [x.split()[0] for x in DOCUMENTS.split(", ")], name
        assert {r["score"] for r in docs.collect()} == {"kept"}
        got = [r["doc_id"] for r in docs.collect()]
        kept -= {"language_id": {70, 71, 72}, "line_dedup": set(), "jaccard_join": {10, 12},
                 "decontamination": {20}}[name]
        assert set(got) == kept and len(got) == len(kept), name
        if name == "line_dedup":
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert [line in texts[i][0] for i in (30, 31, 32)] == [False, False, True]
            assert all(n == len(t) for t, n in texts.values())
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in ids.collect()} == kept
    assert ids.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_keep_columns_of_any_name(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({
        "a.b": F.col("doc_id") * 2, "back`tick": F.lit("y"), "_row": F.lit(1)})
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == names, name
    odd = docs.where("doc_id is not null").select("doc_id", "`a.b`", "`back``tick`").collect()
    assert odd and all(r[1] == 2 * r[0] and r[2] == "y" for r in odd)


def test_run_is_all_stages(spark, corpus):
    folder, rows, _ = corpus
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(got) == len(rows) - 6


def test_stages_take_empty_tables(spark, corpus):
    folder = corpus[0]
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
