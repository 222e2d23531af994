"""Quality rules with verdicts on whole hosts.

Each document is measured and checked by rules. Failures are counted per host and rule; a host's failure rate is
shrunk towards the corpus by a beta prior that is fitted to the spread of all hosts' rates, so that a host with few
documents is judged by little more than the prior. A host whose shrunk rate lies in the upper tail of that prior is
suspect by the rule, and its documents lose the benefit of the doubt: those that break the rule, or come near breaking a base
rule, are rejected too. A host in the tail that fails the base rules more often than not is rejected whole. Where hosts
differ by no more than chance, none is in the tail and the base rules alone decide.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import cut, field, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 5
TAIL = 2.0  # standard deviations of the prior from which on a host is suspect
#: So many hosts with something held against them may be broadcast (some tens of MB); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000


def in_repeated_windows(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in windows of `size` words that are found twice or more. Memory: some numbers a word."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    key = codes
    for j in range(1, size):
        key = np.unique(key[:-1] * len(number) + codes[j:], return_inverse=True)[1]
    at = np.flatnonzero(np.bincount(key)[key] > 1)
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text: words, code points in them, symbols, repeated lines, words in repeated windows."""
    data = (text or "").encode()
    words = data.split()  # bytes know only ASCII white space
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), in_repeated_windows(words)


def _measure(batches, at: int, carried: list[str]):
    for part in slices(batches):
        counts = zip(*map(measure, part.column(at).to_pylist()))
        yield pa.RecordBatch.from_arrays([*part.select(carried).columns, *(pa.array(c, pa.int64()) for c in counts)], [*carried, *MEASURES])


def measured_rows(base: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """The carried columns of base and the five counts of its column `text`, as a scratch table."""
    schema = T.StructType([*(base.schema[c] for c in carried), *(field(m, "bigint") for m in MEASURES)])
    return cut(base.mapInArrow(partial(_measure, at=base.columns.index(text), carried=carried), schema))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rules() -> dict[str, tuple[str, str]]:
    """Rule -> (what counts against the host, what is rejected from a host that is suspect by the rule), in SQL of both engines.

    short and repeats are the base rules. The others are the usual bounds of crawl filters: a symbol for every ten
    words, a repeated line for every thirty, words of under 3 or over 10 characters on average.
    """
    letters = "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)"
    return {
        "short": ("n_words < 10", "n_words < 13"),
        "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words > 15 * n_words"),
        "symbols": ("10 * n_symbols > n_words", "10 * n_symbols > n_words"),
        "lines": ("30 * n_dup_lines > n_words", "30 * n_dup_lines > n_words"),
        "letters": (letters, letters),
    }


def beta_prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """(mean, strength, bound) of each rule's prior, by the method of moments over all hosts; one row reaches the driver.

    The prior is Beta(mean * strength, (1 - mean) * strength); bound lies TAIL of its standard deviations above the
    mean, or halfway from the mean to 1 if that is less, as it is where hosts are either good or bad.
    """
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("n2")]
    for r in names:
        k = F.col(r).cast("double")
        sums += [F.sum(k).alias(f"k_{r}"), F.sum(k * k / n).alias(f"kk_{r}")]
    s = hosts.agg(*sums).first()
    out = {}
    for r in names:
        if not s["n"] or not s[f"k_{r}"] or s[f"k_{r}"] == s["n"]:
            p = s[f"k_{r}"] / s["n"] if s["n"] else 0.0
            out[r] = (p, 1.0, p)  # no host differs from the others
            continue
        p = s[f"k_{r}"] / s["n"]
        # Weighted spread of the hosts' rates, less what binomial noise alone would give: p(1-p) times rho.
        spread = s[f"kk_{r}"] - s["n"] * p * p
        noise, room = (s["hosts"] - 1) * p * (1 - p), (s["n"] - s["n2"] / s["n"] - (s["hosts"] - 1)) * p * (1 - p)
        rho = min(0.99, max(1e-4, (spread - noise) / room if room > 0 else 1e-4))
        out[r] = (p, 1 / rho - 1, min(p + TAIL * (p * (1 - p) * rho) ** 0.5, (1 + p) / 2))
    return out


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source", banned: float = 0.5) -> DataFrame:
    """One row per document: id, host, the five counts, failed (by the base rules), kept.

    A document is kept if it passes the base rules, its host is not banned (shrunk base-failure rate in the prior's upper tail
    and over `banned`), and it does not break, or for base rules nearly break, a rule by which its host is suspect
    (shrunk rate in the prior's upper tail). A document without a host is judged by the base rules alone. Null text has
    no words and fails; rows that repeat an id are documents of their own. Other columns are not read. host_col may be an
    expression, such as one that takes the domain out of an address.
    """
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    base = docs.select(F.col(id_col).alias("id"), host.alias("host"), F.col(text_col).alias("text"))
    return judged(measured_rows(base, "text", ["id", "host"]), banned)


def judged(measured: DataFrame, banned: float = 0.5) -> DataFrame:
    """measured (host, the five counts and any others) with failed and kept for every row."""
    tests = rules()
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    broken = {"base": failed} | {r: F.expr(b) for r, (b, _) in tests.items()}
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(b.cast("bigint")).alias(r) for r, b in broken.items()))
    hosts = cut(hosts)
    prior = beta_prior(hosts, list(broken))
    rate = {r: (F.col(r) + F.lit(p * w)) / (F.col("n") + F.lit(w)) for r, (p, w, _) in prior.items()}
    tail = {r: rate[r] > F.lit(bound) for r, (*_, bound) in prior.items()}
    verdicts = hosts.select(F.col("host").alias("_host"), (tail["base"] & (rate["base"] > banned)).alias("_banned"), *(tail[r].alias(f"_suspect_{r}") for r in tests))
    # only hosts against which something is held are joined back
    verdicts = cut(verdicts.where(" or ".join(["_banned", *(f"_suspect_{r}" for r in tests)])))
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = measured.join(verdicts, F.col("host") == F.col("_host"), "left")
    against = F.coalesce(F.col("_banned"), F.lit(False))
    for r, (_, rejected) in tests.items():
        against = against | (F.coalesce(F.col(f"_suspect_{r}"), F.lit(False)) & F.expr(rejected))
    return joined.select(*measured.columns, failed.alias("failed"), (~failed & ~against).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str | Column = "source", **options) -> DataFrame:
    """docs without those rows that the rules or their host's verdict reject, whatever their ids."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    names = [f"_{i}" for i in range(len(docs.columns))]
    # the columns are numbered meanwhile, as one may have a name that is used here
    base = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), host.alias("host"))
    found = judged(measured_rows(base, names[docs.columns.index(text_col)], base.columns), **options)
    return found.where("kept").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def _oracle() -> str:
    """DuckDB's statement of the base measures, the prior, the hosts' verdicts and the verdict on each document."""
    tests = rules()
    broken = {"base": "failed"} | {r: b for r, (b, _) in tests.items()}
    sums = ", ".join(f"CAST(sum(CASE WHEN {b} THEN 1 ELSE 0 END) AS DOUBLE) AS {r}" for r, b in broken.items())
    moments = ", ".join(f"sum({r}) AS k_{r}, sum({r} * {r} / n) AS kk_{r}" for r in broken)
    rho = ", ".join(
        f"least(0.99, greatest(1e-4, CASE WHEN (n - n2 / n - (hosts - 1)) * (k_{r} / n) * (1 - k_{r} / n) > 0 THEN (kk_{r} - k_{r} * k_{r} / n - (hosts - 1) * (k_{r} / n) * (1 - k_{r} / n)) / ((n - n2 / n - (hosts - 1)) * (k_{r} / n) * (1 - k_{r} / n)) ELSE 1e-4 END)) AS rho_{r}"
        for r in broken
    )
    flat = lambda r: f"(k_{r} = 0 OR k_{r} = p.n)"
    strength = lambda r: f"CASE WHEN {flat(r)} THEN 1 ELSE 1 / rho_{r} - 1 END"
    rate = lambda r: f"(h.{r} + k_{r} / p.n * ({strength(r)})) / (h.n + ({strength(r)}))"
    bound = lambda r: f"CASE WHEN {flat(r)} THEN k_{r} / p.n ELSE least(k_{r} / p.n + {TAIL} * sqrt(k_{r} / p.n * (1 - k_{r} / p.n) * rho_{r}), (1 + k_{r} / p.n) / 2) END"
    tail = lambda r: f"{rate(r)} > {bound(r)}"
    suspects = ", ".join(f"{tail(r)} AS s_{r}" for r in tests)
    against = " OR ".join(["coalesce(banned, false)", *(f"(coalesce(s_{r}, false) AND {rejected})" for r, (_, rejected) in tests.items())])
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH w AS (SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '{word}'), []) AS words,
    list_filter(coalesce(str_split(text, chr(10)), []), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
positions AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
windows AS (SELECT doc_id, i, [word, {', '.join(f'lead(word, {j}) OVER d' for j in range(1, WINDOW))}] AS g, lead(word, {WINDOW - 1}) OVER d AS last FROM positions WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN repeats USING (doc_id)),
d AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {sums} FROM d WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS n, sum(n * n) AS n2, {moments} FROM h),
p AS (SELECT *, {rho} FROM s),
v AS (SELECT h.source, {tail('base')} AND {rate('base')} > 0.5 AS banned, {suspects} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT ({against}) AS kept
FROM d LEFT JOIN v ON d.source = v.source
"""


ORACLE = _oracle()
