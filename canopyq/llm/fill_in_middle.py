"""Fill-in-middle examples: a text is cut in three at hashed places, and its parts change order around marks.

All of it is column expressions. ``regexp_count`` gives the number n of units; a pattern made for the row, with possessive groups of a and of b - a units, then
captures prefix, middle and suffix in one match. Possessive counted groups run in a loop without a stack of choices, so texts of millions of units are cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: A word with the white space before it, or white space that no word follows.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"


def hashed_parts(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups, as unsigned numbers, of the sha256 of the seed, a colon and the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n units, form, prefix, middle, suffix (null if plain), output, and restored, rebuilt from output and form.

    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these with the suffix first. A null or empty text is plain and empty; a text that holds a mark is plain,
    so that marks in an output are unambiguous. Repeated rows, also under one id, give a row each; equal ids are cut at places hashed alike. Other columns are never read.
    An empty table gives no row.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h1, h2, h3, h4 = hashed_parts(F.col("doc_id"), seed)
    units = F.col("n") + 1
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(F.col("text"), F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "a": F.least(h1 % units, h2 % units), "b": F.greatest(h1 % units, h2 % units)})
    pattern = F.format_string(f"(?s)\\A(({UNIT}){{%d}}+)(({UNIT}){{%d}}+)(.*+)\\z".replace(f"({UNIT})", UNIT), F.col("a"), F.col("b") - F.col("a"))
    cut = F.split(F.regexp_replace("text", pattern, F.lit(f"$1{MIDDLE}$2{SUFFIX}$3")), f"{MIDDLE}|{SUFFIX}", -1)
    rows = rows.withColumn("cut", F.when(F.col("form") != "plain", cut))
    rows = rows.withColumns({name: F.get("cut", F.lit(i)) for i, name in enumerate(("prefix", "middle", "suffix"))}).drop("cut", "a", "b")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    rows = rows.withColumn("output", F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text"))).drop("text")
    return rows.withColumn("restored", restored(F.col("output"), F.col("form")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm, psm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)), F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def digests(examples: DataFrame) -> DataFrame:
    """Counts and digests of the examples instead of their texts."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return examples.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
