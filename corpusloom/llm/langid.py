r"""Operator 3: language identification by Bayesian evidence fusion.

Classes are the declared languages of the corpus (primary subtags such as ``en``) with ``LEAST_SHARE`` of the declared text
or more, and ``und``.  A rarer code (markup holds many that are no languages) is evidence like any, but no class.  For
each record

    log P(l | all) = log P(l | host) + TEMPER * log P(text | l) + log P(declared | l) + log P(suffix | l) + const

* P(text | l): character trigrams of the lower-cased text, hashed to ``BUCKETS``, counted over all records that declare
  l, and mixed with ``MIXED`` of the uniform distribution.  Only letters and the spaces beside them make trigrams:
  numbers, addresses and marks are of no language.  TEMPER is 1/3, as every character is in three trigrams.  ``und``
  has the uniform distribution, so a text unlike every language is ``und``, and a few odd words aren't enough for it.
* P(declared | l), P(suffix | l): counted over all records by the language that the text alone gives, plus one.
* P(l | host): counts of the text-only language by host, drawn to those of its domain, drawn to those of all records
  (``PULL`` pseudo-records each); grouped aggregation.  ``und`` has the fixed prior ``UND_PRIOR``.

Plan.  One pass counts trigrams (each task adds its own counts up first), one pass makes the likelihoods, which are
written with the small columns; the rest is on that table.  Texts are never shuffled.  The model sent to the tasks has
BUCKETS numbers a language.

Defined results: a text without a letter, an empty or a null one is ``und``, posterior 1.0; a null or malformed
declaration, address or host is no evidence.  Where no record declares a language there is no model: every record
with some text gets a null language, posterior null, and is accepted.  Equal posteriors go to the language first in the
alphabet.  Repeated rows are records of their own.  Extra columns are carried along if named in ``keys``.  An id that is no
number is null.  ``in_known_language`` judges rows without a doc_id too; rows that share one are one document, which goes
if one of them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import minus, with_ids, written
from .textkit import raw, slices

BUCKETS, ALPHA, MIXED, PULL, UND_PRIOR, LEAST_POSTERIOR = 8192, 0.5, 0.05, 10.0, 0.001, 0.5
#: A declaration that has a smaller share of the trigrams of all declared text is no class, so there are at most 1,000.
LEAST_SHARE = 0.001
TEMPER = 1 / 3
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
LANG = r"^([a-z]{2,3})(?:[-_].*)?$"
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
HTML_LANG = r"(?i)<html[^>]*\slang=[\"']?([A-Za-z_-]+)"


def _or_null(pattern: str, of: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(of), pattern, 1), F.lit(""))


def records_of_documents(docs: DataFrame) -> DataFrame:
    """Records of documents: the column lang is the declaration, source the host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").try_cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"),
        _or_null(LANG, F.col("lang")).alias("declared"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records of web pages: the markup's language attribute is the declaration; host, domain and suffix are the address's."""
    host = _or_null(HOST, F.col("url"))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").try_cast("long").alias("page_id"), F.regexp_replace("html", MARKUP, " ").alias("text"),
        F.nullif(F.regexp_extract(F.lower(F.regexp_extract("html", HTML_LANG, 1)), LANG, 1), F.lit("")).alias("declared"), host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"),
    )


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every trigram, and where each text's begin; a text has a space added at both ends."""
    empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
    padded = pc.if_else(empty, "", pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", ""))
    data, _ = raw(padded)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    n = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    code = (chars[:-2] * 961 + chars[1:-1] * 31 + chars[2:]) % BUCKETS
    letter = ((chars >= 97) & (chars <= 122)) | (chars >= 128)
    side = letter | (chars == 32)
    ends = np.cumsum(n)
    keep = np.zeros(len(chars), bool)
    keep[:-2] = side[:-2] & letter[1:-1] & side[2:]
    keep[(ends[n > 0] - 1)] = keep[(ends[n > 0] - 2)] = False
    return code[keep[:-2]], np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]


def trigram_counts(records: DataFrame) -> DataFrame:
    """(declared, bucket, n) over all records that declare a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                code, of = _trigrams(part.column("text"))
                names = part.column("declared").dictionary_encode()
                whose = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(of))
                both = np.bincount(whose * BUCKETS + code, minlength=len(names.dictionary) * BUCKETS).reshape(-1, BUCKETS)
                for name, n in zip(names.dictionary.to_pylist(), both, strict=True):
                    have[name] = have.get(name, 0) + n
        for name, n in have.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["declared", "bucket", "n"])

    return records.where("declared IS NOT NULL").select("text", "declared").mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(records: DataFrame, langs: list[str], logp: np.ndarray, keys: list[str]) -> DataFrame:
    """keys, declared, host, domain, suffix, n (trigrams) and ``text_log``: the tempered log likelihood by language."""
    sent = records.sparkSession.sparkContext.broadcast(logp)
    out = records.select(*keys, "declared", "host", "domain", "suffix", F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("text_log")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent.value
        for batch in batches:
            for part in slices(batch):
                code, of = _trigrams(part.column("text"))
                sums = np.zeros((part.num_rows, len(logp)))
                some = np.diff(of) > 0
                for j, row in enumerate(logp):
                    if some.any():
                        sums[some, j] = np.add.reduceat(row[code], of[:-1][some])
                lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(logp), dtype=np.int32) if len(logp) else np.zeros(part.num_rows + 1, np.int32), (sums * TEMPER).ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, "declared", "host", "domain", "suffix")), pa.array(np.diff(of)), lists], out.names)

    return records.select(*keys, "declared", "host", "domain", "suffix", "text").mapInArrow(score, out)


def _share(counts: DataFrame, by: list[str], name: str, langs: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("guess") == x, F.col("n"))), F.lit(0)).cast("double") for x in langs)).alias(name))


def identify(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lang, posterior (4 places) and accepted of each record (keys, text, declared, host, domain, suffix)."""
    model = trigram_counts(records).toArrow().combine_chunks()
    names, whose = model.column("declared").to_pylist(), model.column("bucket").to_numpy()
    declared, place = np.unique(np.array(names, object), return_inverse=True) if names else (np.zeros(0, object), np.zeros(0, np.int64))
    found = np.zeros((len(declared), BUCKETS))
    found[place, whose] = model.column("n").to_numpy()
    frequent = found.sum(1) >= LEAST_SHARE * found.sum()
    langs, counts = declared[frequent].tolist(), found[frequent]
    if not langs:
        has = F.coalesce(F.length("text"), F.lit(0)) > 0
        return records.select(*keys, F.when(~has, F.lit("und")).alias("lang"), F.when(~has, F.lit(1.0)).alias("posterior"), has.alias("accepted"))
    logp = np.log((1 - MIXED) * (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS) + MIXED / BUCKETS)
    found = written(likelihoods(records, langs, logp, keys), "likelihoods")
    names = F.array(*map(F.lit, langs))
    found = found.withColumn("guess", F.when(F.col("n") > 0, F.element_at(names, F.array_position("text_log", F.array_max("text_log")).cast("int"))))
    cells = written(found.where("guess IS NOT NULL").groupBy("guess", "declared", "host", "domain", "suffix").agg(F.count("*").alias("n")), "cells")

    def evidence(column: str) -> tuple[DataFrame, Column]:
        """Counts by value as an array of the languages, and the log likelihood of the value by language (0 without one)."""
        known = cells.where(F.col(column).isNotNull())
        totals = {r["guess"]: r["n"] for r in known.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
        kinds = known.select(column).distinct().count()
        total = F.array(*(F.lit(float(totals.get(x, 0) + kinds)) for x in langs))
        log = F.zip_with(f"{column}_n", total, lambda n, t: F.log((n + 1) / t))
        return _share(known, [column], f"{column}_n", langs), F.when(F.col(f"{column}_n").isNotNull(), log).otherwise(F.array_repeat(F.lit(0.0), len(langs)))

    declared, declared_log = evidence("declared")
    suffix, suffix_log = evidence("suffix")
    everything = {r["guess"]: r["n"] for r in cells.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    base = F.array(*(F.lit((everything.get(x, 0) + 1.0) / (sum(everything.values()) + len(langs))) for x in langs))

    def drawn(counts: str, to: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col(counts).isNull(), to).otherwise(F.zip_with(counts, to, lambda n, p: (n + PULL * p) / (total + PULL)))

    hosts = _share(cells.where("host IS NOT NULL"), ["host"], "host_n", langs)
    domains = _share(cells.where("domain IS NOT NULL"), ["domain"], "domain_n", langs)
    joined = found
    for side, on in ((declared, "declared"), (suffix, "suffix"), (hosts, "host"), (domains, "domain")):
        joined = joined.join(side, on, "left")
    joined = joined.withColumn("p", drawn("domain_n", base)).withColumn("p", drawn("host_n", F.col("p"))).withColumn("e", declared_log).withColumn("f", suffix_log)
    logs = F.zip_with(F.zip_with("text_log", "p", lambda t, p: t + F.log(p * (1 - UND_PRIOR))), F.zip_with("e", "f", lambda e, f: e + f), lambda a, b: a + b)
    # und: a uniform choice of trigram, declaration and suffix.
    kinds = {c: max(1, cells.select(c).where(F.col(c).isNotNull()).distinct().count()) for c in ("declared", "suffix")}
    und = F.log(F.lit(UND_PRIOR)) - F.col("n") * TEMPER * float(np.log(BUCKETS))
    for c in kinds:
        und = und - F.when(F.col(f"{c}_n").isNotNull(), F.lit(float(np.log(kinds[c])))).otherwise(0.0)
    scored = joined.withColumn("logs", F.concat(logs, F.array(und))).withColumn("most", F.array_max("logs"))
    best = F.element_at(F.concat(names, F.array(F.lit("und"))), F.array_position("logs", F.col("most")).cast("int"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    none = F.col("n") == 0
    result = scored.select(*keys, F.when(none, F.lit("und")).otherwise(best).alias("lang"), F.when(none, F.lit(1.0)).otherwise(F.round(1 / mass, 4)).alias("posterior"))
    return result.withColumn("accepted", (F.col("lang") != "und") & (F.col("posterior") >= LEAST_POSTERIOR))


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of documents that aren't rejected."""
    gone = identify(records_of_documents(with_ids(docs)), ["doc_id"]).where("NOT accepted")
    return minus(docs, gone.select("doc_id").distinct())


_Q = "'"
_LETTER = "({0} BETWEEN 97 AND 122 OR {0} >= 128)"
SQL = f"""WITH records AS (
  SELECT doc_id, CAST(NULL AS BIGINT) AS page_id, text, nullif(regexp_extract(lower(lang), '{LANG}', 1), '') AS declared, source AS host, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS suffix FROM documents
  UNION ALL
  SELECT NULL, page_id, text, nullif(regexp_extract(lower(attr), '{LANG}', 1), ''), host, nullif(regexp_extract(host, '([^.]+\\.[^.]+)$', 1), ''), nullif(regexp_extract(host, '\\.([^.]+)$', 1), '')
  FROM (SELECT page_id, regexp_replace(html, '{MARKUP}', ' ', 'g') AS text, regexp_extract(html, '{HTML_LANG.replace(_Q, _Q * 2)}', 1) AS attr, nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host FROM pages)),
r AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM records),
c AS MATERIALIZED (SELECT k, list_transform(string_split(' ' || lower(text) || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM r WHERE length(text) > 0),
g AS MATERIALIZED (SELECT k, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: {_LETTER.format('c[i + 1]')} AND (c[i] = 32 OR {_LETTER.format('c[i]')}) AND (c[i + 2] = 32 OR {_LETTER.format('c[i + 2]')})), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % {BUCKETS})) AS b FROM c),
gb AS MATERIALIZED (SELECT k, b, count(*) AS n FROM g GROUP BY k, b),
every AS (SELECT declared AS lang, sum(n) AS n FROM gb JOIN r USING (k) WHERE declared IS NOT NULL GROUP BY 1),
tot AS MATERIALIZED (SELECT lang, n FROM every WHERE n >= {LEAST_SHARE} * (SELECT sum(n) FROM every)),
langs AS (SELECT lang FROM tot),
cnt AS (SELECT declared AS lang, b, sum(n) AS n FROM gb JOIN r USING (k) WHERE declared IS NOT NULL GROUP BY 1, 2),
logp AS MATERIALIZED (SELECT lang, b, ln({1 - MIXED} * (coalesce(cnt.n, 0) + {ALPHA}) / (tot.n + {ALPHA * BUCKETS}) + {MIXED} / {BUCKETS}.0) AS lp FROM langs CROSS JOIN (SELECT DISTINCT b FROM gb) JOIN tot USING (lang) LEFT JOIN cnt USING (lang, b)),
text_log AS MATERIALIZED (SELECT k, lang, sum(gb.n * lp) / 3 AS t, sum(gb.n) AS n FROM gb JOIN logp USING (b) GROUP BY k, lang),
guess AS MATERIALIZED (SELECT k, arg_max(lang, t) AS guess FROM text_log GROUP BY k),
cells AS MATERIALIZED (SELECT guess, declared, host, domain, suffix, count(*) AS n FROM guess JOIN r USING (k) GROUP BY ALL),
nl AS (SELECT count(*) AS l FROM langs),
base AS (SELECT lang, (coalesce(sum(n), 0) + 1.0) / ((SELECT sum(n) FROM cells) + (SELECT l FROM nl)) AS p FROM langs LEFT JOIN cells ON guess = lang GROUP BY lang),
dom AS (SELECT domain, sum(n) AS n FROM cells WHERE domain IS NOT NULL GROUP BY 1), doml AS (SELECT domain, guess AS lang, sum(n) AS n FROM cells WHERE domain IS NOT NULL GROUP BY 1, 2),
hos AS (SELECT host, sum(n) AS n FROM cells WHERE host IS NOT NULL GROUP BY 1), hosl AS (SELECT host, guess AS lang, sum(n) AS n FROM cells WHERE host IS NOT NULL GROUP BY 1, 2),
dec AS (SELECT declared, guess AS lang, sum(n) AS n FROM cells WHERE declared IS NOT NULL GROUP BY 1, 2), dect AS (SELECT guess AS lang, sum(n) AS n FROM cells WHERE declared IS NOT NULL GROUP BY 1),
suf AS (SELECT suffix, guess AS lang, sum(n) AS n FROM cells WHERE suffix IS NOT NULL GROUP BY 1, 2), suft AS (SELECT guess AS lang, sum(n) AS n FROM cells WHERE suffix IS NOT NULL GROUP BY 1),
kinds AS (SELECT count(DISTINCT declared) AS d, count(DISTINCT suffix) AS s FROM cells),
one AS (SELECT k, lang, t, text_log.n AS n, r.host, r.domain, r.declared, r.suffix, base.p AS pg,
  CASE WHEN dom.n IS NULL THEN base.p ELSE (coalesce(doml.n, 0) + {PULL} * base.p) / (dom.n + {PULL}) END AS pd
  FROM text_log JOIN r USING (k) JOIN base USING (lang) LEFT JOIN dom USING (domain) LEFT JOIN doml USING (domain, lang)),
two AS (SELECT one.k, one.lang, one.n,
  t + ln((CASE WHEN hos.n IS NULL THEN pd ELSE (coalesce(hosl.n, 0) + {PULL} * pd) / (hos.n + {PULL}) END) * {1 - UND_PRIOR})
  + CASE WHEN one.declared IS NULL OR NOT EXISTS (SELECT 1 FROM dec x WHERE x.declared = one.declared) THEN 0 ELSE ln((coalesce(dec.n, 0) + 1.0) / (coalesce(dect.n, 0) + kinds.d)) END
  + CASE WHEN one.suffix IS NULL OR NOT EXISTS (SELECT 1 FROM suf x WHERE x.suffix = one.suffix) THEN 0 ELSE ln((coalesce(suf.n, 0) + 1.0) / (coalesce(suft.n, 0) + kinds.s)) END AS lg,
  ln({UND_PRIOR}) - one.n * ln({BUCKETS}.0) / 3 - CASE WHEN one.declared IS NULL THEN 0 ELSE ln(kinds.d) END - CASE WHEN one.suffix IS NULL THEN 0 ELSE ln(kinds.s) END AS ug
  FROM one CROSS JOIN kinds LEFT JOIN hos USING (host) LEFT JOIN hosl ON hosl.host = one.host AND hosl.lang = one.lang
  LEFT JOIN dec ON dec.declared = one.declared AND dec.lang = one.lang LEFT JOIN dect ON dect.lang = one.lang
  LEFT JOIN suf ON suf.suffix = one.suffix AND suf.lang = one.lang LEFT JOIN suft ON suft.lang = one.lang),
three AS (SELECT k, lang, lg FROM two UNION ALL SELECT k, 'und', any_value(ug) FROM two GROUP BY k),
four AS (SELECT k, arg_max(lang, lg) AS lang, max(lg) AS most FROM three GROUP BY k),
five AS (SELECT k, any_value(four.lang) AS lang, round(1 / sum(exp(lg - most)), 4) AS posterior FROM three JOIN four USING (k) GROUP BY k)
SELECT doc_id, page_id, coalesce(lang, 'und') AS lang, coalesce(posterior, 1.0) AS posterior, coalesce(lang <> 'und' AND posterior >= {LEAST_POSTERIOR}, false) AS accepted FROM r LEFT JOIN five USING (k)"""
