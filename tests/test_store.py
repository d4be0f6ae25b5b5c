"""The bucketed store: upserts, redelivery, failures, deletes, untouched files."""

import pytest
from pyspark.sql import functions as F

from docweir.functions import analyze
from docweir.operators import chunking, index
from docweir.sources import store
from docweir.streaming import ingest

SCHEMA = "document_id string, user_id string, filename string, content_type string, language string, raw_text string"


def docs(spark, rows):
    return spark.createDataFrame([(f"d{i}", "u", f"f{i}.txt", kind, lang, body) for i, kind, lang, body in rows], SCHEMA)


def failing_model():
    # a nested function travels to the workers by value
    def model(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("model offline")
        return [[float(len(t)), 1.0] for t in texts]

    return model


def rows(spark, folder):
    """All rows of all tables, without files and buckets."""
    return {t: sorted(map(str, store.read(spark, folder, t).drop("bucket").collect())) for t in store.TABLES}


TEXTS = [(1, "text/plain", "en", "cats running home"), (2, "text/markdown", "pl", "# Tytuł\n\nkoty w domu"), (3, "text/plain", "en", "a poison pill"), (4, "text/plain", None, "x " * 900)]


def test_redelivery_and_a_failing_document(spark, tmp_path):
    folder, source = f"{tmp_path}/store", f"{tmp_path}/in"
    options = {"embedder": failing_model(), "dimension": 2, "analyzers": {"en": analyze.english, "pl": analyze.polish(["w"])}, "buckets": 8}
    docs(spark, TEXTS).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    ingest.start(stream, folder, f"{tmp_path}/first", **options).awaitTermination()
    once = rows(spark, folder)
    # all of it again, twice in one batch, and then by a stream that has lost its checkpoint
    docs(spark, TEXTS + TEXTS[:2]).write.mode("append").parquet(source)
    ingest.start(stream, folder, f"{tmp_path}/first", **options).awaitTermination()
    assert rows(spark, folder) == once
    ingest.start(stream, folder, f"{tmp_path}/second", **options).awaitTermination()
    assert rows(spark, folder) == once
    status = {r.document_id: (r.status, r.error_message) for r in store.read(spark, folder, "statuses").collect()}
    assert status == {"d1": ("completed", None), "d2": ("completed", None), "d3": ("failed", "model offline"), "d4": ("completed", None)}
    for table in ("parents", "chunks", "postings"):
        assert {r.document_id for r in store.read(spark, folder, table).collect()} == {"d1", "d2", "d4"}
    lexemes = {r.document_id: r.lexemes for r in store.read(spark, folder, "postings").groupBy("document_id").agg(F.collect_set("lexeme").alias("lexemes")).collect()}
    assert "cat" in lexemes["d1"] and "run" in lexemes["d1"] and "w" not in lexemes["d2"] and "koty" in lexemes["d2"] and "x" in lexemes["d4"]
    assert all(r.embedding == [float(len("passage: " + r.content)), 1.0] for r in store.read(spark, folder, "chunks").collect())


def test_states_on_the_way(spark, tmp_path, monkeypatch):
    folder, some = str(tmp_path / "store"), docs(spark, TEXTS[:2])

    def states():
        return {r.document_id: r.status for r in store.read(spark, folder, "statuses").collect()}

    store.register(some, folder, buckets=4)
    assert states() == {"d1": "pending", "d2": "pending"} and not store.exists(spark, folder, "chunks")
    with monkeypatch.context() as m:
        m.setattr(chunking, "parse_documents", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.reindex(some.where("document_id = 'd1'"), folder, buckets=4)
    assert states() == {"d1": "in_progress", "d2": "pending"}
    store.reindex(some.select("document_id"), folder, buckets=4)
    assert states() == {"d1": "completed", "d2": "completed"}
    # a document that is cured, and one that falls ill
    store.upsert(docs(spark, [(1, "text/plain", "en", "poison"), (2, "text/plain", "pl", "dom")]), folder, embedder=failing_model(), dimension=2, buckets=4)
    assert states() == {"d1": "failed", "d2": "completed"} and {r.document_id for r in store.read(spark, folder, "postings").collect()} == {"d2"}
    store.upsert(docs(spark, [(1, "text/plain", "en", "cured")]), folder, embedder=failing_model(), dimension=2, buckets=4)
    assert states() == {"d1": "completed", "d2": "completed"}


def test_changes_leave_other_buckets_alone(spark, tmp_path):
    folder, many = str(tmp_path / "store"), [(i, "text/plain", "en", f"text number {i} of many") for i in range(60)]
    store.upsert(docs(spark, many), folder, buckets=16)
    before = {t: {tuple(r) for r in store.files(spark, folder, t).collect()} for t in store.TABLES}
    changed = docs(spark, [(5, "text/plain", "en", "another text")])
    gone = docs(spark, [many[9], many[33]]).select("document_id")
    touched = {r[0] for r in changed.select("document_id").union(gone).select(store.bucket_of(F.col("document_id"), 16)).collect()}
    store.upsert(changed, folder, buckets=16)
    store.delete(gone, folder, buckets=16)
    for t, old in before.items():
        now = {tuple(r) for r in store.files(spark, folder, t).collect()}
        assert {f for f in old if f[0] not in touched} == {f for f in now if f[0] not in touched}
        assert not {f for f in old if f[0] in touched} & now
    left = {f"d{i}" for i in range(60)} - {"d9", "d33"}
    assert all({r.document_id for r in store.read(spark, folder, t).collect()} == left for t in store.TABLES)
    assert "another" in {r.lexeme for r in store.read(spark, folder, "postings").where("document_id = 'd5'").collect()}


def test_emptied_buckets_and_nulls(spark, tmp_path):
    folder = str(tmp_path / "store")
    some = docs(spark, TEXTS[:1]).unionByName(spark.createDataFrame([(None, "u", "f", "text/plain", "en", "x"), ("d7", None, None, None, None, None)], SCHEMA))
    store.upsert(some, folder, buckets=1)
    assert {r.document_id: r.status for r in store.read(spark, folder, "statuses").collect()} == {"d1": "completed", "d7": "completed"}
    store.delete(some.select("document_id"), folder, buckets=1)
    store.upsert(docs(spark, TEXTS[:1]).limit(0), folder, buckets=1)
    store.upsert(docs(spark, TEXTS[3:]), folder, buckets=1)
    assert all({r.document_id for r in store.read(spark, folder, t).collect()} == {"d4"} for t in store.TABLES)


def test_nothing_is_stored_twice(spark, tmp_path, monkeypatch):
    # staged copies hold ids only, also when stored documents are processed or changed
    staged, cut = [], store.cut_lineage
    monkeypatch.setattr(store, "cut_lineage", lambda df: staged.append(df.columns) or cut(df))
    folder, many = str(tmp_path / "store"), docs(spark, [(i, "text/plain", "en", f"text number {i}") for i in range(40)])
    store.register(many, folder, buckets=4)
    store.reindex(many.select("document_id"), folder, buckets=4)
    store.upsert(docs(spark, [(3, "text/plain", "en", "another")]), folder, buckets=4)
    store.delete(many.where("document_id = 'd4'").select("document_id"), folder, buckets=4)
    assert staged and all(columns == ["document_id"] for columns in staged)
    assert {r.document_id for r in store.read(spark, folder, "postings").collect()} == {f"d{i}" for i in range(40)} - {"d4"}
    # files that pile up in a bucket are joined
    for n in range(2 * store.FILES):
        store.register(docs(spark, [(3, "text/plain", "en", f"version {n}")]), folder, buckets=4)
    per_bucket = store.files(spark, folder, "documents").groupBy("bucket").count().collect()
    assert max(r["count"] for r in per_bucket) <= store.FILES + 2
    assert store.read(spark, folder, "documents").where("document_id = 'd3'").first().raw_text == f"version {n}"


def test_a_chunk_has_one_row_in_every_table(spark, tmp_path):
    # a row for each posting made every change write a hundred times the rows of the chunks
    folder, writers = str(tmp_path / "store"), spark.conf.get(store.WRITERS)
    store.upsert(docs(spark, TEXTS + [(5, "text/plain", "en", "--")]), folder, analyzers={"en": analyze.english}, buckets=4)
    store.upsert(docs(spark, TEXTS[:1]), folder, analyzers={"en": analyze.english}, buckets=4)
    store.delete(docs(spark, TEXTS[1:2]).select("document_id"), folder, buckets=4)
    chunks = store.read(spark, folder, "chunks")
    assert spark.read.parquet(f"{folder}/postings").count() == chunks.count()
    want = index.postings(chunks, {"en": analyze.english})
    got = store.read(spark, folder, "postings").drop("bucket").select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 8
    # other writes of the session sort as they did
    assert spark.conf.get(store.WRITERS) == writers


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.createDataFrame([(i, f"a b {i}", "en", "s", 5) for i in range(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.document_id: (r.chunks, r.tokens) for r in entry.queries()["stream_ingest"](spark, str(tmp_path)).collect()}
    assert found == {str(i): (1, 7) for i in range(6)}
