"""Rule bitmask ledger: measurements and failure bits once per document, policies and ablations on the bits.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, word_array

#: Words of a window; three doublings of a word's hash give a window's.
WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"

#: Rule name to a condition on the measurements that a document fails. Its place is the number of its bit.
RULES: Mapping[str, Column] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_exclaims > n_words",
}

#: Policy name and version to the rules it applies. A changed policy gets a new version; old ones stay.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base@1": ("few_words", "repeated_windows"),
    "standard@1": tuple(RULES),
}
POLICY = "standard@1"


def policy_mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(frame: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines and n_repeat_words of whole texts.

    A null text has no words and all measurements 0. ``n_lines`` are the lines with a word. Columns of these
    names that the frame has are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [F.col(f"`{column}`") for column in frame.columns if column.lower() not in added]
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # Each select holds values that the next uses more than once, so none is computed twice.
    split = frame.select(*kept, content.alias("_text"), word_array(content).alias("_words"), lines.alias("_lines"))
    counted = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("_text") - F.char_length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_h1"),
    )

    def doubled(name: str, reach: int) -> Column:
        """Hash of twice as many words per place, from hashes of ``reach`` words each."""
        return F.transform(name, lambda value, at: F.xxhash64(value, F.get(F.col(name), at + reach)))

    def whole(name: str, words: int) -> Column:
        """The hashes of complete windows only."""
        return F.slice(name, 1, F.greatest(F.col("n_words").cast("int") - (words - 1), F.lit(0)))

    pairs = counted.withColumn("_h2", doubled("_h1", 1)).drop("_h1")
    fours = pairs.withColumn("_h4", doubled("_h2", 2)).drop("_h2")
    # The later of two equal windows brings a half window's repeat at each place but its last ones; texts with
    # fewer repeats cannot have one and are spared the rest.
    half = WINDOW_WORDS // 2
    whole_fours = fours.withColumn("_whole4", whole("_h4", half))
    suspect = F.size("_whole4") - F.size(F.array_distinct("_whole4")) > half
    eights = whole_fours.withColumn("_h8", F.when(suspect, doubled("_h4", half))).drop("_h4", "_whole4")
    hashed = eights.withColumn("_hashes", whole("_h8", WINDOW_WORDS)).drop("_h8")
    # Neighbours in the order of hashes share a window's words.
    ordered = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda value, at: F.struct(value.alias("h"), at.alias("at")))),
    )
    sorted_windows = hashed.withColumn("_ordered", ordered).drop("_hashes")
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "_ordered",
                lambda x, k: F.coalesce(x["h"] == F.get(F.col("_ordered"), k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(F.col("_ordered"), k + 1)["h"], F.lit(False)),
            ),
            lambda x: x["at"],
        )
    )
    starts = sorted_windows.withColumn("_starts", repeated).drop("_ordered")
    covered = F.aggregate(
        F.transform(
            "_starts",
            lambda at, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("_starts"), k + 1) - at, F.lit(WINDOW_WORDS))),
        ),
        F.lit(0).cast("long"),
        lambda total, words: total + words,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")


def ledger(frame: DataFrame, text: str = "text") -> DataFrame:
    """Measurements plus failed_bits: every rule evaluated once, failed rules as bits."""
    bits = F.lit(0).cast("long")
    for at, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(frame.drop("failed_bits"), text).withColumn("failed_bits", bits)


def kept_by(policy: str, bits: str = "failed_bits") -> Column:
    """True where a document fails no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule does inside a policy: policy, rule, failed, only_rule, kept, kept_without.

    ``only_rule`` documents fail no other rule of the policy, so leaving the rule out keeps them. Documents are
    first counted per bit pattern, at most 2 to the number of rules; nothing is measured again.
    """
    mask = policy_mask(policy)
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("long").alias("bit")) for rule in POLICIES[policy]
    ]))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return (
        patterns.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
            count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
            count(F.col("bits") == F.col("r.bit")).alias("only_rule"),
            count(F.col("bits") == 0).alias("kept"),
            count((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("kept_without"),
        ).withColumn("policy", F.lit(policy))
    )


def passing(documents: DataFrame, policy: str = POLICY) -> DataFrame:
    """Documents that fail no rule of the policy. All columns are kept, whatever their names."""
    rows = ledger(documents.select(F.struct("*").alias("row"), F.col("text").alias("content")), "content")
    # A filter on a row number is not pushed below it; pushed down, it would repeat the measurements inside itself many times over.
    held = rows.select("row", "failed_bits", F.monotonically_increasing_id().alias("at"))
    return held.filter(kept_by(policy) & (F.col("at") >= 0)).select("row.*")


def op6_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, base_failed, kept, failed_bits and only_rule_bit (the policy's rule that alone rejects it, else 0) of every document.

    Sums of only_rule_bit per rule are the ablations of ``ablations``: documents that leaving the rule out would keep. Texts of any length are measured
    whole, repeated rows each, an empty table gives no rows.
    """
    rows = ledger(read(spark, folder, "documents").select("doc_id", "text"))
    own = F.col("failed_bits").bitwiseAND(F.lit(policy_mask(POLICY)).cast("long"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base@1")).alias("base_failed"), kept_by(POLICY).alias("kept"), "n_lines", "n_exclaims", "failed_bits",
        F.lit(POLICY).alias("policy"), F.when(F.bit_count(own) == 1, own).otherwise(F.lit(0).cast("long")).alias("only_rule_bit"),
    )


OP6_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS row_no
  FROM documents
),
windows AS (
  SELECT row_no, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos
  FROM (SELECT row_no, list_transform(range(1, len(words) - 6), lambda i: hash(words[i:i + 7])) AS runs FROM cut WHERE len(words) >= 8)
),
repeated AS (SELECT row_no, pos FROM (SELECT row_no, pos, count(*) OVER (PARTITION BY row_no, run) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_no, sum(least(8, coalesce(nxt - pos, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT row_no, pos, lead(pos) OVER (PARTITION BY row_no ORDER BY pos) AS nxt FROM repeated) GROUP BY row_no
),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN covered USING (row_no)
),
failed AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_exclaims, failed_bits, 'standard@1' AS policy,
  CASE WHEN bit_count(failed_bits) = 1 THEN failed_bits ELSE 0 END AS only_rule_bit
FROM failed"""
