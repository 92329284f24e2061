"""Readers of the raw formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def tsv(spark: SparkSession, path: str, names: list[str] | None = None, comment: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text; names are for files without a header."""
    r = spark.read.option("sep", "\t").option("quote", "\u0000").option("mode", "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    if names:
        return r.option("header", False).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return r.option("header", header).csv(path)


def stanzas(spark: SparkSession, path: str, kind: str = "Term") -> DataFrame:
    """The [Term] stanzas of an OBO file, one text a row, in one pass of a line-separated read by the stanza's mark."""
    rows = spark.read.text(path, lineSep=f"[{kind}]\n").withColumnRenamed("value", "stanza")
    # what follows a stanza of another kind isn't part of this one, nor is the file's header
    body = F.regexp_extract("stanza", r"(?s)^(.*?)(?:\n\[\w+\]|\z)", 1)
    return rows.select(body.alias("stanza")).where(F.col("stanza").rlike(r"(?m)^id: ") & ~F.col("stanza").startswith("format-version"))


def tag(name: str) -> Column:
    """The first value of a tag of a stanza, or null."""
    x = F.trim(F.regexp_extract("stanza", rf"(?m)^{name}: (.*)$", 1))
    return F.when(x != "", x)


def tags(name: str) -> Column:
    return F.transform(F.regexp_extract_all("stanza", F.lit(rf"(?m)^{name}: (.*)$"), 1), lambda x: F.trim(x))


def quoted(col: Column) -> Column:
    return F.regexp_extract(col, r'"(.*?)"', 1)


def obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name, namespace, definition, synonyms, alt_ids, xrefs, subsets, is_a, links (relation, target) of terms that aren't obsolete."""
    rows = stanzas(spark, path).where(~F.coalesce(tag("is_obsolete"), F.lit("false")).eqNullSafe("true"))
    bare = lambda x: F.trim(F.split(x, " !")[0])
    target = lambda x: F.struct(F.split(x, r"\s+", 2)[0].alias("relation"), bare(F.get(F.split(x, r"\s+", 2), F.lit(1))).alias("target"))
    return rows.select(
        tag("id").alias("id"), tag("name").alias("name"), tag("namespace").alias("namespace"), quoted(tag("def")).alias("definition"),
        F.transform(F.filter(tags("synonym"), lambda x: x.contains('"')), quoted).alias("synonyms"),
        F.transform(F.filter(tags("synonym"), lambda x: x.rlike(r'^"[^"]*" EXACT')), quoted).alias("exact_synonyms"),
        tags("alt_id").alias("alt_ids"), F.transform(tags("xref"), lambda x: F.split(x, r"\s")[0]).alias("xrefs"), F.transform(tags("subset"), lambda x: F.split(x, r"\s")[0]).alias("subsets"),
        F.transform(tags("is_a"), bare).alias("is_a"), F.transform(F.filter(tags("relationship"), lambda x: F.size(F.split(x, r"\s+", 2)) == 2), target).alias("links"),
    )


def edges_of(terms: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """child, parent, relation of the is_a lines and of the relationships named."""
    is_a = terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"), F.lit("is_a").alias("relation")).where("parent != ''")
    other = terms.select(F.col("id").alias("child"), F.explode("links").alias("l")).select("child", F.col("l.target").alias("parent"), F.col("l.relation").alias("relation"))
    return is_a.unionByName(other.where(F.col("relation").isin(*relations) & (F.col("parent") != "")))


def attribute(col: Column, name: str) -> Column:
    """A value of GFF3 attributes."""
    x = F.regexp_extract(col, rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(x != "", x)


def xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Elements as rows of one text column each, for xpath expressions; name spaces are dropped, whichever the file declares."""
    raw = spark.read.text(path, lineSep=f"</{row}>").withColumnRenamed("value", "x")
    begun = F.regexp_extract("x", rf"(?s)(<{row}[\s>].*)", 1)
    clean = F.regexp_replace(F.regexp_replace(F.concat(begun, F.lit(f"</{row}>")), r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")
    return raw.where(F.col("x").rlike(rf"<{row}[\s>]")).select(F.regexp_replace(clean, r"\sxsi:\w+=\"[^\"]*\"", "").alias("x"))


def texts(path: str) -> Column:
    return F.expr(f"xpath(x, '{path}/text()')")


def text(path: str) -> Column:
    x = F.trim(F.get(texts(path), F.lit(0)))
    return F.when(x != "", x)
