"""Registered queries: keyword, vector and hybrid search, answer rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweir.catalog.inputs import table
from docweir.catalog.registry import query
from docweir.catalog.text import POSTINGS, _TOK, document_chunks
from docweir.functions import analyze
from docweir.operators import bm25, fusion, index, render, vectors
from docweir.plans import hybrid

LANGUAGES = ("en", "fr", "de", "es")
COLUMNS = {lang: ("query", analyze.simple) for lang in LANGUAGES}

# one branch of the SQL side: query terms, document frequency, IDF, scores
_TERMS = f"""qtok AS MATERIALIZED (SELECT item_id, {_TOK.format(c='text')} AS words FROM benchmark),
    terms AS (SELECT DISTINCT item_id, lexeme FROM (SELECT item_id, unnest(words) AS lexeme FROM qtok) x),
    vocab AS (SELECT DISTINCT lexeme FROM terms),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(wc) AS avg_words FROM toks),
    freq AS (SELECT lang, p.lexeme, count(*) AS doc_freq FROM post p JOIN vocab v ON p.lexeme = v.lexeme GROUP BY 1, 2),
    idfs AS (SELECT lang, lexeme, doc_freq, ln((n - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE) + 1) AS idf FROM freq, stats)"""
_WEIGHT = "idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wc / avg_words))"
_BM25 = f"""scored AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum({_WEIGHT}), 6) AS score
        FROM post p JOIN idfs i ON p.lang = i.lang AND p.lexeme = i.lexeme JOIN terms t ON t.lexeme = p.lexeme, stats GROUP BY 1, 2),
    keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored
        QUALIFY rank <= 50)"""


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("all").alias("user_id"), F.col("text").alias("query")
    )


def _keyword(spark, sf):
    chunks = document_chunks(spark, sf)
    terms = index.query_terms(benchmark_queries(spark, sf), COLUMNS)
    return bm25.search(terms, index.postings(chunks), chunks, digits=6)


@query("query_terms", f"WITH {POSTINGS}, {_TERMS} SELECT item_id AS query_id, lang AS language, lexeme FROM terms, (VALUES ('en'), ('fr'), ('de'), ('es')) l(lang)")
def query_terms(spark, sf):
    return index.query_terms(benchmark_queries(spark, sf), COLUMNS).drop("user_id")


@query(
    "blank_query_guard",
    f"""WITH b AS MATERIALIZED (SELECT item_id, {_TOK.format(c='text')} AS words FROM benchmark WHERE text LIKE '%ing%')
    SELECT item_id AS query_id, count(DISTINCT w) AS terms FROM (SELECT item_id, unnest(words) AS w FROM b) x GROUP BY 1""",
)
def blank_query_guard(spark, sf):
    queries = benchmark_queries(spark, sf).withColumn(
        "query", F.when(F.contains("query", F.lit("ing")), F.col("query")).otherwise(F.lit("  \n "))
    )
    terms = index.query_terms(queries, {"en": ("query", analyze.simple)})
    return terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))


@query(
    "bm25_df_idf",
    f"WITH {POSTINGS}, {_TERMS} SELECT lang AS language, lexeme, doc_freq, round(idf, 6) AS idf FROM idfs",
)
def bm25_df_idf(spark, sf):
    chunks = document_chunks(spark, sf)
    terms = index.query_terms(benchmark_queries(spark, sf), COLUMNS)
    weighed = bm25.term_idf(terms, index.postings(chunks), index.corpus_stats(chunks))
    return weighed.where(F.col("doc_freq") > 0).groupBy("language", "lexeme").agg(
        F.max("doc_freq").alias("doc_freq"), F.round(F.max("idf"), 6).alias("idf")
    )


@query("bm25_topk", f"WITH {POSTINGS}, {_TERMS}, {_BM25} SELECT query_id, chunk_id, chunk_id AS document_id, score, rank FROM keyword")
def bm25_topk(spark, sf):
    return _keyword(spark, sf)


@query(
    "language_or_match",
    f"""WITH {POSTINGS}, {_TERMS} SELECT t.item_id AS query_id, lang AS language, count(DISTINCT doc_id) AS chunks
      FROM post p JOIN terms t ON t.lexeme = p.lexeme GROUP BY 1, 2""",
)
def language_or_match(spark, sf):
    terms = index.query_terms(benchmark_queries(spark, sf), COLUMNS)
    matched = bm25.matched_chunks(terms, index.postings(document_chunks(spark, sf)))
    return matched.groupBy("query_id", "language").agg(F.count(F.lit(1)).alias("chunks"))


_SCOPE = """scope AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN labels l ON (l.doc_id + b.item_id) % 4 = 0)"""


def query_scope(spark, sf):
    """Each query is bound to a quarter of the labelled documents."""
    slots = table(spark, sf, "labels").select((F.col("doc_id") % 4).alias("slot"), F.col("doc_id").alias("document_id"))
    queries = benchmark_queries(spark, sf).withColumn("slot", (4 - F.col("query_id") % 4) % 4)
    return queries.join(slots, "slot").select("query_id", "user_id", "document_id")


@query(
    "bm25_scoped",
    f"""WITH {POSTINGS}, {_TERMS.split('vocab AS')[0].rstrip().rstrip(',')}, {_SCOPE},
    sstats AS (SELECT query_id, count(*)::DOUBLE AS n, avg(wc) AS avg_words FROM scope s JOIN toks t ON t.doc_id = s.doc_id GROUP BY 1),
    hits AS (SELECT s.query_id, p.doc_id, lang, p.lexeme, tf, wc FROM scope s JOIN post p ON p.doc_id = s.doc_id
        JOIN terms t ON t.item_id = s.query_id AND t.lexeme = p.lexeme),
    sfreq AS (SELECT query_id, lang, lexeme, count(*) AS df FROM hits GROUP BY 1, 2, 3),
    scored AS (SELECT h.query_id, h.doc_id AS chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE
          / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wc / avg_words))), 6) AS score FROM hits h JOIN sfreq f
          ON f.query_id = h.query_id AND f.lang = h.lang AND f.lexeme = h.lexeme JOIN sstats s ON s.query_id = h.query_id GROUP BY 1, 2)
    SELECT query_id, chunk_id, chunk_id AS document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM scored QUALIFY rank <= 50""",
)
def bm25_scoped(spark, sf):
    chunks = document_chunks(spark, sf)
    terms = index.query_terms(benchmark_queries(spark, sf), COLUMNS)
    return bm25.search_scoped(terms, query_scope(spark, sf), index.postings(chunks), chunks, digits=6)


@query("bm25_stemmed")
def bm25_stemmed(spark, sf):
    chunks = document_chunks(spark, sf)
    columns = {lang: ("query", analyze.english if lang == "en" else analyze.simple) for lang in LANGUAGES}
    terms = index.query_terms(benchmark_queries(spark, sf), columns)
    return bm25.search(terms, index.postings(chunks, {"en": analyze.english}), chunks, digits=6)


# ---- vectors ------------------------------------------------------------------------------------


def label_queries(spark, sf):
    """One query vector per label, the mean of the label's vectors; two users by parity."""
    items = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = items.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")
    ).select(
        F.col("label").cast("bigint").alias("query_id"),
        F.concat(F.lit("u"), (F.col("label") % 2).cast("string")).alias("user_id"), "embedding",
    )


def vector_chunks(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"),
        F.concat(F.lit("u"), (F.col("label") % 2).cast("string")).alias("user_id"), "embedding",
    )


_CENTERS = """items AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centers AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM items GROUP BY 1, 2) m GROUP BY 1)"""
_DIST = "round(list_cosine_distance(embedding::DOUBLE[], q), 6)"


@query(
    "vector_topk",
    f"""WITH {_CENTERS} SELECT c.label::BIGINT AS query_id, vec_id AS chunk_id, {_DIST} AS distance, round(1 - {_DIST}, 6) AS similarity,
        row_number() OVER (PARTITION BY c.label ORDER BY {_DIST}, vec_id) AS rank
      FROM centers c JOIN embeddings e ON c.label % 2 = e.label % 2 QUALIFY rank <= 50""",
)
def vector_topk(spark, sf):
    found = vectors.top_k(vector_chunks(spark, sf), label_queries(spark, sf), digits=6)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "vector_topk_scoped",
    f"""WITH {_CENTERS} SELECT c.label::BIGINT AS query_id, vec_id AS chunk_id, {_DIST} AS distance,
        row_number() OVER (PARTITION BY c.label ORDER BY {_DIST}, vec_id) AS rank
      FROM centers c JOIN embeddings e ON c.label % 2 = e.label % 2 JOIN labels l ON l.doc_id = e.vec_id AND l.quality = c.label % 3 % 2
      QUALIFY rank <= 50""",
)
def vector_topk_scoped(spark, sf):
    queries = label_queries(spark, sf)
    flags = queries.select("query_id", (F.col("query_id") % 3 % 2).cast("int").alias("quality"))
    scope = flags.join(table(spark, sf, "labels"), "quality").select("query_id", F.col("doc_id").alias("document_id"))
    return vectors.top_k_scoped(vector_chunks(spark, sf), queries, scope, digits=6).drop("similarity")


@query("embed_chunks", "SELECT doc_id AS chunk_id, 64 AS n FROM documents")
def embed_chunks(spark, sf):
    rows = document_chunks(spark, sf).select("chunk_id", "content")
    vecs = vectors.embed(rows, vectors.hashing_embedder(64), dimension=64)
    return vectors.check_dimension(vecs, 64).select("chunk_id", F.size("embedding").alias("n"))


# ---- fusion -------------------------------------------------------------------------------------


def hybrid_queries(spark, sf):
    """Benchmark queries, each with the mean vector of the label it falls on."""
    centers = label_queries(spark, sf).select(F.col("query_id").alias("label"), "embedding")
    return benchmark_queries(spark, sf).withColumn("label", F.col("query_id") % 10).join(centers, "label").drop("label")


def hybrid_corpus(spark, sf):
    chunks = document_chunks(spark, sf)
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    vecs = chunks.select("chunk_id", "document_id", "user_id").join(vecs, "chunk_id")
    group = F.floor(F.col("document_id") / 4).cast("bigint")
    full = chunks.withColumn(
        "parent_id", F.when(F.col("document_id") % 7 != 0, F.concat(F.lit("p"), group.cast("string")))
    ).withColumn("chunk_index", (F.col("document_id") % 4).cast("int"))
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string"))).alias("source_url"),
    )
    parents = full.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(
        F.concat(F.lit("parent "), F.first("parent_id")).alias("content")
    )
    return hybrid.Corpus(full, index.postings(chunks), documents, parents, vecs)


_VECTOR = f"""vector AS (SELECT b.item_id AS query_id, vec_id AS chunk_id,
        row_number() OVER (PARTITION BY b.item_id ORDER BY {_DIST}, vec_id) AS rank
      FROM benchmark b JOIN centers c ON c.label = b.item_id % 10, embeddings e WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 50)"""
_FUSED = """fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
        v.rank AS vector_rank, k.rank AS bm25_rank, coalesce(1::DOUBLE / (60 + v.rank), 0) + coalesce(1::DOUBLE / (60 + k.rank), 0) AS rrf
      FROM vector v FULL JOIN keyword k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rrf_rank
      FROM fused QUALIFY rrf_rank <= {n})"""
_HEAD = f"WITH {POSTINGS}, {_TERMS}, {_BM25}, {_CENTERS}, {_VECTOR}"


def _fused(spark, sf):
    corpus, queries = hybrid_corpus(spark, sf), hybrid_queries(spark, sf)
    keyword = hybrid.keyword_branch(queries, corpus, COLUMNS, 50, 6)
    vector = hybrid.vector_branch(queries, corpus, 50, 6)
    return corpus, queries, fusion.fuse(vector, keyword)


@query("rrf_fuse", f"{_HEAD}, {_FUSED.format(n=50)} SELECT query_id, chunk_id, vector_rank, bm25_rank, round(rrf, 9) AS rrf FROM fused")
def rrf_fuse(spark, sf):
    return _fused(spark, sf)[2].withColumn("rrf", F.round("rrf", 9))


@query(
    "rrf_any_lists",
    """WITH lists AS (SELECT user_id AS query_id, event_type AS lane, event_id AS chunk_id,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 50)
    SELECT query_id, chunk_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS rrf FROM lists GROUP BY 1, 2""",
)
def rrf_any_lists(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    lists = table(spark, sf, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 50").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "rank"
    )
    return fusion.reciprocal_rank(lists).withColumn("rrf", F.round("rrf", 9))


@query("candidate_cut", f"{_HEAD}, {_FUSED.format(n=7)} SELECT query_id, chunk_id, rrf_rank FROM cut")
def candidate_cut(spark, sf):
    return fusion.cut(_fused(spark, sf)[2], 7).select("query_id", "chunk_id", "rrf_rank")


_SCORE = f"""qt AS MATERIALIZED (SELECT item_id, list_distinct({_TOK.format(c='text')}) AS ws FROM benchmark),
    dt AS MATERIALIZED (SELECT doc_id, list_distinct(words) AS ws FROM toks),
    ranked AS (SELECT c.*, CASE WHEN len(qt.ws) > 0 THEN len(list_intersect(qt.ws, dt.ws))::DOUBLE / len(qt.ws) ELSE 0 END AS rerank_score,
        CASE WHEN chunk_id % 7 <> 0 THEN 'p' || (chunk_id // 4) END AS parent_id
      FROM cut c JOIN qt ON qt.item_id = c.query_id JOIN dt ON dt.doc_id = c.chunk_id)"""
_ORDERED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS final_rank FROM ranked),
    firsts AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(parent_id, chunk_id::VARCHAR) ORDER BY final_rank) = 1),
    answers AS (SELECT f.query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS rank,
        CASE WHEN parent_id IS NOT NULL THEN 'parent ' || parent_id ELSE d.text END AS chunk_content, doc_id AS document_id,
        'doc-' || doc_id AS document_filename, doc_id % 4 AS chunk_index, round(rerank_score, 6) AS score,
        CASE WHEN doc_id % 3 = 0 THEN 'https://x.org/' || doc_id END AS source_url
      FROM firsts f JOIN documents d ON d.doc_id = f.chunk_id QUALIFY rank <= 7)"""
_ANSWERS = f"{_HEAD}, {_FUSED.format(n=50)}, {_SCORE}, {_ORDERED}"


@query("rerank_lexical", f"{_HEAD}, {_FUSED.format(n=50)}, {_SCORE}, {_ORDERED} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, final_rank FROM ordered")
def rerank_lexical(spark, sf):
    corpus, queries, fused = _fused(spark, sf)
    rows = fusion.hydrate(fusion.cut(fused), corpus.chunks, corpus.documents, corpus.parents).join(
        queries.select("query_id", "query"), "query_id"
    )
    ranked = fusion.rerank(rows, fusion.lexical_score(F.col("query"), F.col("content")))
    return ranked.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


@query(
    "rerank_model",
    f"""{_HEAD}, {_FUSED.format(n=50)}, scored2 AS (SELECT c.*, CAST(length(text) % 97 AS DOUBLE) AS rerank_score FROM cut c JOIN documents d ON d.doc_id = c.chunk_id)
    SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS final_rank FROM scored2""",
)
def rerank_model(spark, sf):
    corpus, queries, fused = _fused(spark, sf)
    rows = fusion.hydrate(fusion.cut(fused), corpus.chunks, corpus.documents, corpus.parents).join(
        queries.select("query_id", "query"), "query_id"
    )

    def scorer(text, candidates):
        return [(i, float(len(c) % 97)) for i, c in enumerate(candidates)]

    scored = rows.withColumn("m", fusion.model_score(scorer)(F.col("query"), F.col("content")))
    return fusion.rerank(scored, F.col("m.score"), F.col("m.failed")).select("query_id", "chunk_id", "rerank_score", "final_rank")


def _answers(spark, sf):
    found = hybrid.hybrid_search(
        hybrid_queries(spark, sf), hybrid_corpus(spark, sf), COLUMNS, digits=6, vector_digits=6
    )
    return found.withColumn("score", F.round("score", 6)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("hybrid_search", f"{_ANSWERS} SELECT * REPLACE (md5(chunk_content) AS chunk_content) FROM answers")
def hybrid_search(spark, sf):
    return _answers(spark, sf).withColumn("chunk_content", F.md5("chunk_content"))


@query("parent_collapse", f"{_ANSWERS} SELECT query_id, count(*) AS results, count(*) FILTER (chunk_content LIKE 'parent %') AS parents FROM answers GROUP BY 1")
def parent_collapse(spark, sf):
    return _answers(spark, sf).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.startswith("chunk_content", F.lit("parent "))).alias("parents")
    )


@query(
    "context_block",
    f"""{_ANSWERS}, blocks AS (SELECT query_id, string_agg('[' || rank || '] (source: ' || document_filename || ', chunk ' || chunk_index || ')' || chr(10)
        || CASE WHEN source_url IS NOT NULL THEN 'Source: ' || source_url || chr(10) || chr(10) ELSE '' END || chunk_content, chr(10) || chr(10) ORDER BY rank) AS context
        FROM answers GROUP BY 1)
    SELECT item_id AS query_id, md5(CASE WHEN context IS NOT NULL THEN '<CONTEXT>' || chr(10) || context || chr(10) || '</CONTEXT>' || chr(10) || chr(10)
        || '<QUESTION>' || chr(10) || text || chr(10) || '</QUESTION>' ELSE text END) AS message FROM benchmark b LEFT JOIN blocks k ON k.query_id = b.item_id""",
)
def context_block(spark, sf):
    messages = render.prompt(benchmark_queries(spark, sf), render.context_block(_answers(spark, sf)))
    return messages.select("query_id", F.md5("message").alias("message"))


@query("context_chunks", f"{_ANSWERS} SELECT query_id, rank AS index, document_id, score FROM answers")
def context_chunks(spark, sf):
    rows = render.context_chunks(_answers(spark, sf)).select("query_id", F.explode("context").alias("c"))
    return rows.select("query_id", "c.index", "c.document_id", "c.score")


@query(
    "retrieval_markdown",
    f"""{_ANSWERS}, named AS (SELECT *, coalesce(source_url, document_filename) AS name FROM answers),
    src AS (SELECT query_id, string_agg('  - ' || name, chr(10) ORDER BY first) AS sources FROM
        (SELECT query_id, name, min(rank) AS first FROM named GROUP BY 1, 2) s GROUP BY 1),
    parts AS (SELECT query_id, string_agg('### Source: ' || name || chr(10) || chunk_content || chr(10), chr(10) ORDER BY rank) AS body FROM named GROUP BY 1)
    SELECT item_id AS query_id, md5(CASE WHEN sources IS NULL THEN '---' || chr(10) || 'sources: []' || chr(10) || '---' || chr(10) || chr(10) || 'No relevant documentation found.'
        ELSE '---' || chr(10) || 'sources:' || chr(10) || sources || chr(10) || '---' || chr(10) || chr(10) || body END) AS markdown
      FROM benchmark b LEFT JOIN src s ON s.query_id = b.item_id LEFT JOIN parts p ON p.query_id = b.item_id""",
)
def retrieval_markdown(spark, sf):
    out = render.markdown_answer(benchmark_queries(spark, sf), _answers(spark, sf))
    return out.select("query_id", F.md5("markdown").alias("markdown"))


@query(
    "combined_query",
    """SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN pl || ' ; ' || en ELSE en || ' ; ' || pl END AS query,
        CASE WHEN item_id % 4 = 0 THEN 'none' WHEN item_id % 4 = 1 THEN 'all' ELSE 'listed' END AS mode
      FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN text ELSE 'en ' || text END AS en,
                   CASE WHEN item_id % 2 = 0 THEN text ELSE 'pl ' || text END AS pl FROM benchmark) b""",
)
def combined_query(spark, sf):
    n, raw = F.col("query_id"), F.col("query")
    rows = benchmark_queries(spark, sf)
    en = F.when(n % 5 != 0, F.concat(F.lit("en "), raw))
    pl = F.when(n % 2 != 0, F.concat(F.lit("pl "), raw))
    lists = F.when(n % 4 == 1, F.array().cast("array<string>")).when(n % 4 > 1, F.array(n.cast("string")))
    return rows.select(
        "query_id",
        render.combined_query(F.when(n % 3 == 0, "polish").otherwise("english"), en, pl, raw).alias("query"),
        render.retrieval_mode(lists).alias("mode"),
    )
