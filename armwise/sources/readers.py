"""Readers of records, annotations, ontologies and tables, all through Spark's readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = (
    "record_id string, experiment string, model string, example_id string, modality string, condition string, schema_version string, "
    "payload string, intervention string, ground_truth string, provenance map<string,string>, input string, output struct<raw:string,parsed:string>"
)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | StructType) -> DataFrame:
    """JSON lines; a broken line is tolerated only where it is the last of its file, else reading fails at once.

    Broken lines are looked at in one pass over the text: a line that does not parse and is not at its file's end is an error.
    """
    text = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
    bad = text.where(F.try_parse_json("value").isNull())
    last = text.groupBy("_file").agg(F.max("_at").alias("_last"))
    if bad.join(last, "_file").where("_at < _last").limit(1).count():
        raise ValueError("a line that is not JSON stands before the end of its file")
    return text.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, any broken one an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_shards(spark: SparkSession, folder: str, schema: str, name: str = "records.jsonl") -> DataFrame:
    """A records file and its numbered shards (.0, .1, ...), and nothing else of the folder, with each row's shard."""
    rows = spark.read.schema(schema).option("pathGlobFilter", f"{name}*").json(folder).withColumn("shard_file", F.col("_metadata.file_name"))
    return rows.where(F.col("shard_file").rlike(rf"^{name.replace('.', '[.]')}([.][0-9]+)?$"))


def read_containing(spark: SparkSession, path: str, needle: str, schema: str) -> DataFrame:
    """JSON lines that contain a text, which is looked for before any is decoded."""
    return spark.read.text(path).where(F.contains("value", F.lit(needle))).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_done(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The keys of the rows that parse; broken ones count as not done."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(*keys).distinct()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, fields of any length and with line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)


def read_gaf(spark: SparkSession, path: str, evidence: Sequence[str], aspects: dict[str, str], taxon: str | None = None, kind: str | None = None) -> DataFrame:
    """accession, term, aspect and earliest date of curated annotations that are not denied."""
    g = _gaf(spark, path).where(F.col("evidence").isin(*evidence) & ~F.array_contains(F.split("qualifier", r"\|"), "NOT"))
    if taxon:
        g = g.where(F.startswith("taxon", F.lit(f"taxon:{taxon}")))
    if kind:
        g = g.where(F.col("kind") == kind)
    names = F.create_map(*[F.lit(x) for kv in aspects.items() for x in kv])
    return g.withColumn("aspect", names[F.col("aspect")]).where("aspect is not null").groupBy("accession", "term", "aspect").agg(F.min("date").alias("date"))


def read_gaf_signs(spark: SparkSession, path: str) -> DataFrame:
    """accession with its denied and its affirmed terms."""
    denied = F.array_contains(F.split("qualifier", r"\|"), "NOT")
    return _gaf(spark, path).groupBy("accession").agg(F.collect_set(F.when(denied, F.col("term"))).alias("denied"), F.collect_set(F.when(~denied, F.col("term"))).alias("affirmed"))


def _gaf(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    fields = {"accession": 1, "qualifier": 3, "term": 4, "evidence": 6, "aspect": 8, "kind": 11, "taxon": 12, "date": 13}
    return spark.read.text(path).where(~F.startswith("value", F.lit("!"))).select(*[F.get(f, i).alias(n) for n, i in fields.items()])


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """id, name, aspect, alternatives, parents by is_a and by part_of, and exact synonyms of every term that is not obsolete."""
    stanza = F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("s")
    t = spark.read.text(path, wholetext=True).select(stanza).where(F.startswith(F.ltrim("s"), F.lit("[Term]")) & ~F.col("s").rlike(r"(?m)^is_obsolete:\s*true"))

    def one(tag: str) -> Column:
        return F.nullif(F.regexp_extract("s", rf"(?m)^{tag}: *([^\n!]*?) *(?:!|$)", 1), F.lit(""))

    def every(pattern: str) -> Column:
        return F.regexp_extract_all("s", F.lit(pattern), F.lit(1))

    return t.select(
        one("id").alias("id"), one("name").alias("name"), one("namespace").alias("aspect"), every(r"(?m)^alt_id: *(\S+)").alias("alternatives"),
        every(r"(?m)^is_a: *(\S+)").alias("is_a"), every(r"(?m)^relationship: *part_of +(\S+)").alias("part_of"), every(r'(?m)^synonym: *"([^"]*)" +EXACT').alias("synonyms"),
    )


def obo_edges(terms: DataFrame, relations: Sequence[str] = ("is_a", "part_of")) -> DataFrame:
    """child, parent and relation of edges whose both ends are known terms."""
    known = terms.select(F.col("id").alias("parent"))
    rows = terms.select(F.col("id").alias("child"), F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).alias("to")) for r in relations])).alias("e"))
    return rows.select("child", F.explode("e.to").alias("parent"), "e.relation").join(known, "parent", "left_semi").select("child", "parent", "relation")


def name_index(terms: DataFrame) -> DataFrame:
    """name and id for names and exact synonyms in lower case that mean one term only."""
    names = terms.select("id", F.explode(F.concat(F.array("name"), "synonyms")).alias("name")).select("id", F.lower("name").alias("name"))
    return names.groupBy("name").agg(F.collect_set("id").alias("ids")).where(F.size("ids") == 1).select("name", F.col("ids")[0].alias("id"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """term and weight of a two-column table; lines that do not fit are left out."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, 0).alias("term"), F.get(f, 1).try_cast("double").alias("weight")).where("weight is not null")


def read_indented(spark: SparkSession, path: str, indent: str = "--") -> DataFrame:
    """file, line_no, depth and name of an indent-coded list."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    lead = F.regexp_extract("value", f"^(?:{indent})*", 0)
    return rows.select("file", "line_no", (F.length(lead) / len(indent)).cast("int").alias("depth"), F.expr("substring(value, 1 + length(regexp_extract(value, '^(?:" + indent + ")*', 0)))").alias("name"))


def single_status(rows: DataFrame, key: str, status: str) -> DataFrame:
    """Keys with one status only, and it."""
    return rows.groupBy(key).agg(F.collect_set(status).alias("_s")).where(F.size("_s") == 1).select(key, F.col("_s")[0].alias(status))


def long_expression(rows: DataFrame, cell: str, genes: Sequence[str]) -> DataFrame:
    """cell, gene and value of the non-zero entries of a wide expression table."""
    return rows.unpivot([cell], list(genes), "gene", "value").where("value <> 0")


def cell_sentence(expression: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value", k: int = 1000) -> DataFrame:
    """cell, its k highest genes as one string in order, and the rest as an array."""
    ranked = expression.withColumn("_r", F.row_number().over(Window.partitionBy(cell).orderBy(F.desc(value), gene)))
    held = ranked.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("_r", gene))).alias("_g"))
    genes = F.transform("_g", lambda s: s[gene])
    return held.select(cell, F.array_join(F.slice(genes, 1, k), " ").alias("sentence"), F.slice(genes, k + 1, 1 << 30).alias("remainder"))
