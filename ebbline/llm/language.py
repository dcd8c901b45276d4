"""Language of web pages by Bayesian fusion of four kinds of evidence.

Text: likelihoods of symbol trigrams under models counted over all documents whose language is
given. Markup: the language a page declares. Address: the suffix of its host. Host: a prior per
host, smoothed towards its domain's, which is smoothed towards all pages'; a page is left out of
its own prior. The last three are learnt from the pages themselves: sums, by group, of what the
texts say. Groups are aggregated before they are shuffled, so a hot host costs a row per task.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm import symbols as S
from ebbline.sources.staging import stage

ORDER = 3
CELLS = S.SIZE**ORDER
# Languages form a closed list; their models are broadcast.
MOST_LANGUAGES = 256
# Trigrams are not independent: a text counts as so many at most.
EFFECTIVE = 200
HOST_WEIGHT, DOMAIN_WEIGHT, CUE_WEIGHT = 5.0, 20.0, 1.0

_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})"


def visible_text(html: str) -> str:
    return " ".join(_HIDDEN.sub(" ", html).split())


def language_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities of each trigram, from (text, lang) rows."""

    def rows(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                total = np.zeros(CELLS, np.int64)
                for symbols, _ in S.runs(batch.column(0).filter(pa.array(langs == lang))):
                    total += np.bincount(S.grams(symbols, ORDER), minlength=CELLS)
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                    ["lang", "gram", "c"],
                )

    known = docs.where("lang is not null and text is not null")
    counts = known.select("text", "lang").mapInArrow(rows, "lang string, gram int, c bigint")
    counts = stage(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "trigrams")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = np.full((len(langs), CELLS), 0.5)
    for i, lang in enumerate(langs):
        held = counts.where(F.col("lang") == lang).select("gram", "c").toPandas()  # at most 2**18 rows
        model[i, held["gram"].to_numpy()] += held["c"].to_numpy()
    return langs, np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """``pages`` (page_id, host, declared, html) with log likelihoods ``said`` instead of html."""
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))

    def rows(batches):
        table = shared.value
        for batch in batches:
            out = []
            for html in batch.column("html"):
                symbols = next(S.runs(pa.array([visible_text(html.as_py() or "")], pa.string())))[0]
                found = S.grams(symbols, ORDER)[:-1]
                total = np.zeros(table.shape[1])
                for i in range(0, len(found), 1 << 16):
                    total += table[found[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
                out.append(total * min(1.0, EFFECTIVE / max(len(found), 1)) if len(found) > ORDER else total * 0)
            kept = [batch.column(c) for c in ("page_id", "host", "declared")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "declared", "said"])

    return pages.mapInArrow(rows, "page_id bigint, host string, declared string, said array<double>")


def _normalised(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Per group, the sum of ``belief`` per language."""
    total = F.array(*[F.sum(F.col("belief")[i]) for i in range(n)])
    return rows.groupBy(*by).agg(total.alias(name))


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id``, ``lang``, ``posterior``, ``text_lang``, ``declared``, ``host`` for every page.

    ``pages`` has page_id, url, html; ``docs`` text and lang to learn from. A page without text
    says nothing by it and is decided by the other evidence; a null url has the empty host; no
    declaration is a cue like any other. Equal posteriors go to the first language by code point.
    Rows that repeat a page are decided each. Without any labelled text, lang and posterior are
    null. Other columns are not looked at; an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    declared = F.lower(F.coalesce(F.regexp_extract(F.col("html").cast("string"), _DECLARED, 1), F.lit("")))
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), declared.alias("declared"), F.col("html").cast("string").alias("html"))
    langs, model = language_models(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not langs:
        none = F.lit(None)
        return plain.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("posterior"), none.cast("string").alias("text_lang"), "declared", "host")
    n = len(langs)
    rows = _likelihoods(plain, model).withColumn("belief", _normalised(F.col("said")))
    rows = rows.withColumns({"domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0), "suffix": F.regexp_extract("host", r"[^.]*$", 0)})
    rows = stage(rows, "pages")
    everywhere = _sums(rows, [], n, "b").select("b").scalar()
    rows = rows.withColumn("all_b", everywhere)
    for key in ("host", "domain", "declared", "suffix"):
        rows = rows.join(_sums(rows.select(key, "belief"), [key], n, f"{key}_b"), key)

    def size(column: str) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)

    def smoothed(i: Column) -> Column:
        """Log prior of the host, without the page itself."""
        own = F.get("belief", i)
        whole = (F.get("all_b", i) - own + 1.0) / (size("all_b") - 1.0 + n)
        domain = (F.get("domain_b", i) - own + DOMAIN_WEIGHT * whole) / (size("domain_b") - 1.0 + DOMAIN_WEIGHT)
        return F.log(F.greatest((F.get("host_b", i) - own + HOST_WEIGHT * domain) / (size("host_b") - 1.0 + HOST_WEIGHT), F.lit(1e-12)))

    def cue(i: Column, key: str) -> Column:
        """Log probability of the cue's value under a language, without the page itself."""
        own = F.get("belief", i)
        share = size(f"{key}_b") / size("all_b")
        return F.log(F.greatest((F.get(f"{key}_b", i) - own + CUE_WEIGHT * share) / (F.get("all_b", i) - own + CUE_WEIGHT), F.lit(1e-12)))

    places = F.array(*[F.lit(i) for i in range(n)])
    fused = F.transform(places, lambda i: F.get("said", i) + smoothed(i) + cue(i, "declared") + cue(i, "suffix"))
    names = F.array(*[F.lit(x) for x in langs])

    def best(column: str) -> Column:
        return F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))

    rows = rows.withColumn("fused", fused).withColumn("posteriors", _normalised(F.col("fused")))
    return rows.select("page_id", best("posteriors").alias("lang"), F.array_max("posteriors").alias("posterior"), best("belief").alias("text_lang"), "declared", "host")
