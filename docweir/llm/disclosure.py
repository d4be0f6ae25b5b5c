"""Personal data by pattern, and terms that give it away by corpus co-occurrence.

Patterns find the protected entities. A term discloses one as far as seeing the term makes an
entity within CONTEXT_WORDS likely: its strength is the lower confidence bound (Wilson, CONFIDENCE
standard deviations) of the share of its occurrences in the whole corpus that stand near an
entity, those inside entities left out, and its information is the logarithm of that bound over the
share of all terms that stand near one (pointwise mutual information, in bits). A term of at least
MIN_BITS is replaced by its kind from strength ``generalise`` on and taken out from ``remove`` on. A
term seen once or twice beside an entity proves nothing at this confidence; three of three pass
0.5. Counting and finding read all texts; between them only a filter of fixed size goes
to the tasks, and exact joins on the term decide.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import key_filter, maybe_in, signed, slices, span_hashes, spans_of, stored

KINDS = ("email", "ip", "card", "phone")
CUE = "cue"
CONTEXT_WORDS = 3
CONTEXT_CHARS = 400
GENERALISE = 0.5
REMOVE = 0.9
CONFIDENCE = 1.645
MIN_BITS = 1.0
HELD_TERMS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the run of digits is taken whole: no start within it could reach the dot behind it either
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local characters up to each @, no further back than the match before, and the domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        # a text without @ between here and there cannot start another match
        last = max(last, at + 1) if not found else last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every pattern match that passes its check, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub(r"[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters a-z (A-Z folded) and characters beyond ASCII: bytes, starts, ends, hashes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    starts, ends = spans_of(_TERM[data])
    return data, starts, ends, span_hashes(data, starts, ends)


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Starts and ends of the stretches that matches cover; overlapping ones are one."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def outer_terms(text: str, covered: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms outside the covered stretches: starts and ends (code points), hashes."""
    parts, at = [], 0
    for start, end in covered:
        parts += [text[at:start], " " * (end - start)]
        at = end
    data, starts, ends, hashes = terms("".join([*parts, text[at:]]))
    if len(data) == len(text):
        return starts, ends, hashes
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points[starts], points[ends], hashes


def context_terms(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Terms within CONTEXT_WORDS of an entity, at most CONTEXT_CHARS away and outside all entities; an occurrence counts once."""
    covered = united(spans)
    starts, ends, hashes = outer_terms(text, covered)
    near = np.zeros(len(hashes), dtype=bool)
    for i, (start, end) in enumerate(covered):
        low = max(start - CONTEXT_CHARS, covered[i - 1][1] if i else 0)
        high = min(end + CONTEXT_CHARS, covered[i + 1][0] if i + 1 < len(covered) else len(text))
        # a term that the window cuts in two is none
        first, last = np.searchsorted(starts, low), np.searchsorted(ends, start, "right")
        near[max(first, last - CONTEXT_WORDS) : last] = True
        first, last = np.searchsorted(starts, end), np.searchsorted(ends, high, "right")
        near[first : min(last, first + CONTEXT_WORDS)] = True
    return signed(hashes[near]).tolist()


BASE_SCHEMA = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start: int, kind: int, end: int>>, context array<long>"
)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
         ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("context", pa.list_(pa.int64()))]
    )
    for batch in batches:
        rows = []
        for key, text_key, value in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
            text = value.as_py() or ""
            spans = base_spans(text)
            numbers = [k for _, k, _ in spans]
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
            base = [{"start": s, "kind": k, "end": e} for s, k, e in spans]
            rows.append((key, text_key, *(numbers.count(k) for k in range(4)), digest, base, context_terms(text, spans) if spans else []))
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_key"), F.col(text).alias("text"))


def detected(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The stored pattern matches of every document, with the terms around them."""
    return stored(_keyed(docs, text, doc_id).mapInArrow(_detect, BASE_SCHEMA))


def lower_bound(near: Column, total: Column) -> Column:
    """Wilson's lower bound of a share of ``near`` in ``total`` cases."""
    z2, share = CONFIDENCE**2, near / total
    spread = F.sqrt(share * (1 - share) / total + z2 / (4 * total * total))
    return (share + z2 / (2 * total) - CONFIDENCE * spread) / (1 + z2 / total)


def least_near(strength: float) -> int:
    """Occurrences near an entity below which no share can reach that strength: the bound of n in n is n / (n + z^2)."""
    return 1 if strength <= 0 else (1 << 62) if strength >= 1 else max(1, math.ceil(strength * CONFIDENCE**2 / (1 - strength) - 1e-9))


def risky_terms(docs: DataFrame, found: DataFrame, text: str = "text", generalise: float = GENERALISE, min_bits: float = MIN_BITS) -> DataFrame:
    """Terms whose disclosure strength reaches ``generalise``: term, near, total, strength and bits.

    Terms that stand near an entity too seldom to reach it are left out of the count of all texts.
    """
    near = found.select(F.explode("context").alias("term")).groupBy("term").agg(F.count("*").alias("near"))
    near = stored(near.filter(F.col("near") >= least_near(generalise)))
    bits = key_filter(near, "term")

    def rows(known: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(known)), pa.array(n.astype(np.int64))], names=["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sum per term and task, written out early where a task meets very many terms; the sum over all terms has no term
        known, sums, n_all = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0
        for part in (p for batch in batches for p in slices(batch)):
            kept = []
            for value in part.column(0):
                body = value.as_py() or ""
                hashes = outer_terms(body, united(base_spans(body)))[2]
                n_all += len(hashes)
                kept.append(hashes[maybe_in(bits, hashes)])
            different, n = np.unique(np.concatenate(kept), return_counts=True)
            merged, at = np.unique(np.concatenate((known, different)), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate((sums, n)), minlength=len(merged)).astype(np.int64)
            known = merged
            if len(known) > HELD_TERMS:
                yield rows(known, sums)
                known, sums = known[:0], sums[:0]
        yield rows(known, sums)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_all], pa.int64())], names=["term", "n"])

    totals = stored(docs.select(F.col(text)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("total")))
    everything = totals.filter("term IS NULL").first()
    beside = found.agg(F.sum(F.size("context"))).first()[0] or 0
    base = beside / everything["total"] if everything and everything["total"] else 1.0
    told = near.join(totals, "term").withColumn("strength", lower_bound(F.col("near"), F.col("total")))
    told = told.withColumn("bits", F.log2(F.col("strength") / F.lit(base or 1.0)))
    return told.filter((F.col("strength") >= generalise) & (F.col("bits") >= min_bits))


def cue_spans(docs: DataFrame, risky: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every place of a risky term outside the matches: document, text key, start, end (code points) and strength."""
    bits = key_filter(risky, "term")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text_key, value in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
                body = value.as_py() or ""
                starts, ends, hashes = outer_terms(body, united(base_spans(body)))
                hit = np.flatnonzero(maybe_in(bits, hashes))
                rows += zip([key] * len(hit), [text_key] * len(hit), signed(hashes)[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), strict=True)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "term", "start", "end"])

    rows = _keyed(docs, text, doc_id).mapInArrow(places, "doc_id long, text_key long, term long, start int, end int")
    return rows.join(risky.select("term", "strength"), "term")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", generalise: float = GENERALISE) -> DataFrame:
    """Per document: counts and digest of the pattern matches, all spans, and the cues with their strength.

    Matches of each kind are leftmost and do not overlap; those that fail their check
    are dropped. A cue is a risky term anywhere in the corpus; what stands in a match is part
    of it and not listed. A null text is empty; rows that repeat an id are rows of their
    own. An empty table gives no rows.
    """
    found = detected(docs, text, doc_id)
    risky = stored(risky_terms(docs, found, text, generalise))
    cue = F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("end"), F.col("strength"))
    # copies of a row bring the same places; a set keeps them once
    cues = cue_spans(docs, risky, text, doc_id).groupBy(F.col("doc_id").alias("cue_doc"), F.col("text_key").alias("cue_key")).agg(F.array_sort(F.collect_set(cue)).alias("cues"))
    same = F.col("doc_id").eqNullSafe(F.col("cue_doc")) & (F.col("text_key") == F.col("cue_key"))
    joined = found.join(cues, same, "left")

    joined = joined.withColumn("cues", F.coalesce("cues", F.expr("cast(array() as array<struct<start: int, kind: int, end: int, strength: double>>)")))
    plain = F.transform("cues", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in (*KINDS, CUE)])
    written = F.transform(F.array_sort(F.concat("base", plain)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return joined.select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(written, ",").alias("spans"), "base", "cues")


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", remove: float = REMOVE, **options: float) -> DataFrame:
    """Documents with matches replaced by their kind, and cues by ``[cue]`` or, from ``remove`` on, by nothing."""
    spans = find(docs, text, doc_id, **options).select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), "base", "cues").dropDuplicates(["span_doc", "span_key"])
    key = F.coalesce(F.xxhash64(F.col(text)), F.lit(0))
    joined = docs.join(spans, F.col(doc_id).cast("long").eqNullSafe(F.col("span_doc")) & (key == F.col("span_key")), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.element_at(names, b["kind"] + 1).alias("put")))
    cues = F.transform("cues", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(c["strength"] >= remove, "").otherwise(f"[{CUE}]").alias("put")))
    body = F.coalesce(F.col(text), F.lit(""))
    # text between spans and what stands for each, from left to right; overlapping matches share their end
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = F.aggregate(
        F.array_sort(F.concat(base, cues)), start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.when(s["start"] > acc["at"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"])).otherwise(""), F.when(s["start"] >= acc["at"], s["put"]).otherwise("")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), step)).drop("span_doc", "span_key", "base", "cues")
