"""Fill-in-middle transformation by a counted-quantifier pattern (operator 13).

A text is a row of units. regexp_count gives their number n; two draws from 0..n cut it. The cut is
one match of a pattern written for the row: a possessive group of exactly `a` units, one of exactly
`b - a`, and the rest. Possessive groups never give units back, so the engine steps through a text of
any length without recursion, and one replacement of that match writes the transformed text. Undoing
it is one match too. Everything runs in the JVM, inside one projection of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.shared import documents

#: What a text is cut into: runs of ASCII letters, and every other code point by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Per cent of the documents that stay plain, and of the others those written suffix first.
PLAIN, SPM = 10, 20
#: A whole transformed text; the lazy groups end at the first marker, which no text holds itself.
_PSM = f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\\z"
_SPM = f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\\z"


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers: the first digits of the sha256 of the seed and the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_pattern(first: Column, second: Column) -> Column:
    """The pattern whose groups are the first `first` units, those up to `second`, and the rest."""
    unit = "(?:[A-Za-z]++|[^A-Za-z])"
    return F.concat(F.lit(f"(?s)\\A({unit}{{"), first.cast("string"), F.lit(f"}}+)({unit}{{"), (second - first).cast("string"), F.lit("}+)(.*)\\z"))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Cut each text at two random units and move its middle to the end.

    Gives per row doc_id, n (units), form (plain, psm or spm), output, prefix_chars and middle_chars
    (code points; null if plain). `plain` per cent of the texts stay as they are, as do empty ones and
    those that hold a marker; of the others `spm` per cent are written suffix first. The draws follow
    from seed and doc_id alone, so rows of one doc_id are cut by the same draws, and reruns agree. A
    null text is empty; a null doc_id draws as an empty id; rows that repeat are transformed each;
    other columns are ignored; an empty table gives none. No row leaves its partition.
    """
    h1, h2, h3, h4 = (F.col(f"h{k}") for k in range(1, 5))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({f"h{k}": h for k, h in enumerate(draws(seed, F.col("doc_id")), 1)})
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains("text", F.lit(marker))
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), cut_pattern(F.least(x, y), F.greatest(x, y)).alias("pattern"))
    written = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", F.col("pattern"), written))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    at = {m: F.locate(m, "output") for m in MARKERS}  # from 1; the first is the marker itself
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - 1 - len(PREFIX)).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] - len(MIDDLE) + 1)
    return rows.withColumns({"prefix_chars": prefix.cast("long"), "middle_chars": middle.cast("long")})


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed, from what was written and its form."""
    psm, spm = F.regexp_replace(output, _PSM, "$1$3$2"), F.regexp_replace(output, _SPM, "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


_DRAW = "cast(concat('0x', substr(digits, {}, 8)) as bigint)"
#: Units are list entries here, and pieces are joined slices of the list.
OP13_SQL = f"""with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u,
  sha256(concat('1:', coalesce(cast(doc_id as varchar), ''))) as digits from documents),
drawn as (select *, len(u) as n, {_DRAW.format(1)} % (len(u) + 1) as x, {_DRAW.format(9)} % (len(u) + 1) as y,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or {_DRAW.format(17)} % 100 >= {100 - PLAIN} then 'plain'
  when {_DRAW.format(25)} % 100 < {SPM} then 'spm' else 'psm' end as form from units),
cut as (select *, coalesce(array_to_string(u[1:least(x, y)], ''), '') as p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') as m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') as s from drawn)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) else concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) end) as output_sha256,
  sha256(text) as restored_sha256 from cut"""
