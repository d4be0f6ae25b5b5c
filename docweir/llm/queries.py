"""The registered queries of the operators, over whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import bestfit, collisions, curriculum, diagonals, disclosure, dom_trees, exact_merge, hyperdim, merkle, negatives, relations, suffix_trees, tournament


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return dom_trees.main_text(pages, dom_trees.train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_exact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_merge.exact_groups(_table(spark, sf_dir, "documents")).drop("row")


def op3_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.pack(_table(spark, sf_dir, "documents"), special=True)


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    return curriculum.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken")


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = collisions.usable(_table(spark, sf_dir, "embeddings"))
    return collisions.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_bestfit_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed_matrices(_table(spark, sf_dir, "documents"), special=True)


def op8_hyperdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    guessed = hyperdim.identify(docs, hyperdim.prototypes(docs))
    return guessed.select("doc_id", hyperdim.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonals.scan(_table(spark, sf_dir, "documents"))


def op10_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.jaccard_components(_table(spark, sf_dir, "documents")).drop("row", "component")


def op11_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.without_repeats(_table(spark, sf_dir, "documents"))


def op12_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    shown = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), tampered, F.col("text"))
    return merkle.verified(merkle.manifest(_table(spark, sf_dir, "documents"), carry={"shown": shown}))


def op13_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.usable(_table(spark, sf_dir, "embeddings"), label=label)
    return negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"))


OPERATORS = (
    op1_dom_trees, op2_exact_merge, op3_tournament_packing, op4_curriculum, op5_disclosure, op6_collision_search, op7_bestfit_matrices,
    op8_hyperdim, op9_diagonals, op10_set_relations, op11_suffix_trees, op12_merkle_descent, op13_shared_lists,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_merge"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

ORACLES["op4_curriculum"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(CAST(doc_id AS VARCHAR)) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM s WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS wanted,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN wanted // source_size * size + greatest(0, least(size, wanted % source_size - before)) ELSE 0 END AS taken
FROM r
"""

# crc32 bit by bit: a byte is xored in, then eight steps (-1) shift the register
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


ORACLES["op12_merkle_descent"] = f"""
WITH RECURSIVE marked AS (SELECT *, {_CRC} % 7 = 0 AS crc_hit FROM documents),
d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('(CASE WHEN crc_hit THEN n_chars + 1 ELSE n_chars END)')} AS shown FROM marked),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, up FROM (
    SELECT *, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY tree ORDER BY pos), '')) AS up FROM nodes WHERE n > 1
  ) u WHERE pos % 2 = 0
),
tops AS (SELECT tree, digest AS subroot, tree - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, up FROM (
    SELECT *, sha256(digest || coalesce(lead(digest) OVER (ORDER BY pos), '')) AS up FROM upper WHERE n > 1
  ) u WHERE pos % 2 = 0
),
steps AS (
  SELECT l.tree, l.pos, p.level, 0 AS part, (l.pos >> p.level) % 2 AS bit, s.digest AS sibling
  FROM l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) p ON p.tree = l.tree
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = p.level AND s.pos = xor(l.pos >> p.level, 1)
  UNION ALL
  SELECT l.tree, l.pos, p.level, 1, ((l.tree - 1) >> p.level) % 2, s.digest
  FROM l CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) p
  LEFT JOIN upper s ON s.level = p.level AND s.pos = xor((l.tree - 1) >> p.level, 1)
),
paths AS (
  SELECT tree, pos, coalesce(string_agg(sibling, '' ORDER BY part, level), '') AS siblings,
    list(CASE WHEN sibling IS NULL THEN '-' WHEN bit = 1 THEN '<' || sibling ELSE '>' || sibling END ORDER BY part, level) AS path
  FROM steps GROUP BY ALL
),
r AS (
  SELECT l.doc_id, l.leaf, t.subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(l.shown, coalesce(path, [])), lambda a, s: CASE s[1] WHEN '-' THEN sha256(a) WHEN '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM l JOIN tops t USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM r
"""

ORACLES["op13_shared_lists"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""

ORACLES["op11_suffix_trees"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS ord, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT rid, ord, first, md5(array_to_string(words[first:first + 49], ' ')) AS body
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS first FROM d WHERE len(words) >= 50) u
), repeated AS (
  SELECT rid, first FROM windows QUALIFY min(ord) OVER (PARTITION BY body) < ord
), gone AS (
  SELECT DISTINCT rid, unnest(range(first, first + 50)) AS place FROM repeated
), placed AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d
), kept AS (
  SELECT p.rid, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM placed p ANTI JOIN gone g ON g.rid = p.rid AND g.place = p.place GROUP BY p.rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
