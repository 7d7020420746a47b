"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps what was measured and one failure bit per
rule. A policy is a version of the rules and a mask: a document passes it if no failed rule is in the mask.
Ablations (what a policy would keep without one rule) are bitwise aggregates over the ledger, so that texts
are read only once whatever the number of policies: the bits of any version follow from the measurements.

Variety is held against the whole text up to v2, which length alone fails, as vocabulary grows slower than
text. From v3 on it is the mean over windows of VARIETY_WINDOW words (the last one ends with the text), which
length does not change; all windows count, and texts of up to one window are judged as before. What repeats
over longer distances is left to repeated_words, which compares the whole text.

Defined results: a null text has no word (all measures 0, too_few_words set); a blank text likewise;
repeated rows and extra columns pass through untouched; texts of any length are measured whole, in one row (about ten times
their size in memory); a measurement that equals a rule's limit passes it; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import SPACE, word_array

WINDOW = 8
VARIETY_WINDOW = 4096

#: name -> failed, from the measurements. The order fixes the bits; new rules are appended.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "40 * n_symbols > word_chars",
    "shouting": "5 * n_upper > 2 * word_chars",
    "low_variety": "8 * n_distinct_words < n_words",
    "repeated_lines": "10 * n_dup_lines > 7 * n_lines",
    "word_length": "word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words",
}
#: version -> rules that are measured in another way than RULES says, under the same bit.
REVISED: dict[str, dict[str, str]] = {
    "v3": {"low_variety": f"8 * n_window_distinct < IF(n_words > {VARIETY_WINDOW}, {VARIETY_WINDOW} * ceil(n_words / {VARIETY_WINDOW}), n_words)"},
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]

#: version -> mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": sum(BIT.values()),
    "v2_no_variety": sum(BIT.values()) & ~BIT["low_variety"],
    "v3": sum(BIT.values()),
}
CURRENT = "v3"
#: The version that OP2_SQL states.
RECORDED = "v1"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_window_distinct"]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; O(n log n) in the number of windows."""

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        repeated = F.filter(
            pairs,
            lambda p, i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i + 1 < n) & F.coalesce(same(i, i + 1), F.lit(False))),
        )
        starts = F.sort_array(F.transform(repeated, lambda p: p["i"]))
        zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda a, s: F.struct((a["words"] + WINDOW - F.greatest(F.lit(0), a["end"] - s)).alias("words"), (s + WINDOW).alias("end")),
            lambda a: a["words"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered)).cast("long")


def _window_distinct(words: Column) -> Column:
    """Distinct words of each window of VARIETY_WINDOW words, added up; of the whole text if it is no longer."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(VARIETY_WINDOW))
    counts = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(words, F.least(i, n - VARIETY_WINDOW) + 1, VARIETY_WINDOW))).cast("long"))
    added = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    return F.when(n > VARIETY_WINDOW, added).otherwise(F.size(F.array_distinct(words)).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with the measurements in a struct column `_measures`; only built-in expressions."""
    value = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    lines = F.filter(F.split(value, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")
    n = F.size("_words")
    windows = F.when(
        n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    # A generator of one row stands between the measurements and what uses them: the optimizer would else
    # move filters below them and work the measurements out anew for every rule.
    return (
        docs.withColumn("_words", word_array(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .select(
            *docs.columns,
            F.inline(F.array(F.struct(F.struct(
                n.cast("long").alias("n_words"),
                without(SPACE + "+").cast("long").alias("word_chars"),
                (F.length(value) - without(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                _repeat_words(F.col("_windows")).alias("n_repeat_words"),
                F.size("_lines").cast("long").alias("n_lines"),
                F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
                (F.length(value) - without(r"\p{Lu}+")).cast("long").alias("n_upper"),
                _window_distinct(F.col("_words")).alias("n_window_distinct"),
            ).alias("_measures")))),
        )
    )


def fail_bits(version: str = CURRENT) -> Column:
    """The failure bits of the version's rules, from columns of the measures' names."""
    bits = F.lit(0).cast("long")
    for name, rule in (RULES | REVISED.get(version, {})).items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements and fail_bits (of the current version): what policies and ablations need, without the texts."""
    measured = measure(docs.select(F.col(key), F.col(text)), text).select(key, "_measures.*")
    return measured.withColumn("fail_bits", fail_bits())


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with the version's fail_bits and `kept`: no failed rule is in the policy's mask."""
    return book.withColumn("fail_bits", fail_bits(version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents it fails, documents that only it rejects (kept without it),
    and documents that the whole policy rejects. One aggregation of the ledger; nothing is read again."""
    mask = POLICIES[version]
    hit = fail_bits(version).bitwiseAND(F.lit(mask).cast("long"))
    rules = [name for name in RULES if BIT[name] & mask]
    counts = [F.struct(F.lit(r).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias("failed"), F.count_if(hit == BIT[r]).alias("only_rule")) for r in rules]
    out = book.agg(F.array(*counts).alias("rules"), F.count_if(hit != 0).alias("rejected"), F.bit_or(hit).alias("any_bits"))
    return out.select(F.explode("rules").alias("r"), "rejected", "any_bits").select(F.lit(version).alias("policy"), "r.*", "rejected", "any_bits")


def filter_documents(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    measured = measure(inner, "_text").select("_row", "_measures.*")
    kept = apply_policy(measured, version).filter("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(8, nxt - i))::BIGINT AS n
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct_words,
         (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
r AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    ((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 40 * n_symbols > word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN 5 * n_upper > 2 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 8 * n_distinct_words < n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 7 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words THEN 64 ELSE 0 END))::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits
FROM r
"""


def op2(docs: DataFrame) -> DataFrame:
    """The per-document rule record under the policy of its SQL."""
    book = apply_policy(ledger(docs), RECORDED)
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


ABLATIONS_SQL = f"""
WITH b AS (SELECT fail_bits AS f FROM ({OP2_SQL}) AS x),
u(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())}),
t AS (SELECT count(*) FILTER (f <> 0) AS rejected, bit_or(f) AS any_bits FROM b)
SELECT '{RECORDED}' AS policy, rule, count(*) FILTER ((f & bit) <> 0) AS failed, count(*) FILTER (f = bit) AS only_rule, any_value(rejected) AS rejected, any_value(any_bits) AS any_bits
FROM u CROSS JOIN t LEFT JOIN b ON true GROUP BY rule, bit
"""
