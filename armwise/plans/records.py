"""Registered queries over files: records, annotations and ontologies written from the test tables and read back; checks and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions import sequence as S
from armwise.operators import checks as C
from armwise.operators import ontology as O
from armwise.plans.catalog import ARMS, Tables, answers, query
from armwise.sources import arrays as N
from armwise.sources import readers as R
from armwise.sources import writers as W

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string"


def new(t: DataFrame, name: str) -> str:
    return W.scratch(t.sparkSession, name)


def order_lines(t: Tables, name: str) -> tuple[DataFrame, str]:
    """The orders and a path where they are JSON lines."""
    o, path = t("orders"), new(t("orders"), name)
    W.write_jsonl(o.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit("2").alias("schema_version")), path)
    return o, path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src1_truncated_tail(t):
    n = t("nation")
    whole = n.select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("value"))
    cut = n.sparkSession.createDataFrame([('{"n_nationkey": 99, "n_na',)], "value string")
    path = new(n, "truncated")
    whole.coalesce(1).union(cut).coalesce(1).write.text(path)
    return R.read_jsonl(n.sparkSession, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src2_examples(t):
    o, path = order_lines(t, "examples")
    return R.read_jsonl(o.sparkSession, path, ORDER + ", schema_version string").drop("schema_version")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src3_strict_records(t):
    o, path = order_lines(t, "strict")
    return R.read_strict(o.sparkSession, path, ORDER)


@query("SELECT o_orderstatus, count(*) AS n, 3 AS files FROM orders GROUP BY 1")
def src4_numbered_shards(t):
    o, path = t("orders"), new(t("orders"), "shards")
    W.write_shards(o.select("o_orderkey", "o_custkey", "o_orderstatus"), path, 3)
    W.write_shards(o.select("o_orderkey"), f"{path}/other", 1, "records.jsonl.bak")
    rows = R.read_shards(o.sparkSession, path, ORDER)
    files = rows.select("shard_file").distinct().agg(F.count(F.lit(1)).cast("int").alias("files"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(files))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def src5_condition_in_scan(t):
    o, path = order_lines(t, "scan")
    return R.read_jsonl(o.sparkSession, path, ORDER).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def src6_text_prefilter(t):
    o, path = order_lines(t, "prefilter")
    return R.read_containing(o.sparkSession, path, '"o_orderstatus":"P"', ORDER).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def src7_done_keys(t):
    o, path = t("orders"), new(t("orders"), "done")
    line = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    W.write_lines(o, F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("{broken "), F.substring(line, 2, 20))).otherwise(line), path)
    return R.read_done(o.sparkSession, path, ORDER, ["o_orderkey"])


@query("SELECT conv_id, turn, role, md5(coalesce(nullif(text, ''), '-')) AS digest FROM conversations")
def src9_csv_fields(t):
    c, path = t("conversations").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.lit("-"))), new(t("conversations"), "csv")  # CSV cannot tell nothing from empty
    W.write_csv(c, path)
    return R.read_csv(c.sparkSession, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


GAF = """SELECT 'U' || chr(9) || 'P' || CAST(l_partkey AS STRING) || chr(9) || 'n' || chr(9) || CASE WHEN l_discount > 0.08 THEN 'NOT|enables' ELSE 'enables' END || chr(9) || 'GO:' || CAST(l_suppkey AS STRING) || chr(9) || 'r' || chr(9) ||
 CASE l_returnflag WHEN 'A' THEN 'IDA' WHEN 'R' THEN 'IEA' ELSE 'IMP' END || chr(9) || 'w' || chr(9) || CASE WHEN l_linestatus = 'F' THEN 'P' WHEN l_linenumber = 7 THEN 'X' ELSE 'F' END || chr(9) || 'x' || chr(9) || 'y' || chr(9) ||
 CASE WHEN l_linenumber = 6 THEN 'complex' ELSE 'protein' END || chr(9) || 'taxon:' || CASE WHEN l_linenumber < 5 THEN '9606' ELSE '10090' END || chr(9) || CAST(20000000 + l_orderkey AS STRING) || chr(9) || 'z' AS value FROM lineitem"""


def gaf(t: Tables, name: str) -> tuple[DataFrame, str]:
    li, path = t("lineitem"), new(t("lineitem"), name)
    lines = li.sparkSession.sql(GAF.replace("FROM lineitem", "FROM {li}"), li=li)
    lines.union(li.sparkSession.createDataFrame([("!gaf-version: 2.2",)], "value string")).write.text(path)
    return li, path


@query("""SELECT 'P' || l_partkey AS accession, 'GO:' || l_suppkey AS term, CASE WHEN l_linestatus = 'F' THEN 'process' ELSE 'function' END AS aspect, min((20000000 + l_orderkey)::VARCHAR) AS date FROM lineitem
WHERE l_discount <= 0.08 AND l_returnflag <> 'R' AND l_linenumber < 5 GROUP BY 1, 2, 3""")
def src10_annotations(t):
    li, path = gaf(t, "gaf")
    return R.read_gaf(li.sparkSession, path, ["IDA", "IMP"], {"P": "process", "F": "function"}, "9606", "protein")


@query("""SELECT 'P' || l_partkey AS accession, coalesce(list_sort(list(DISTINCT 'GO:' || l_suppkey) FILTER (l_discount > 0.08)), []) AS denied, coalesce(list_sort(list(DISTINCT 'GO:' || l_suppkey) FILTER (l_discount <= 0.08)), []) AS affirmed FROM lineitem GROUP BY 1""")
def src11_annotation_signs(t):
    li, path = gaf(t, "signs")
    signs = R.read_gaf_signs(li.sparkSession, path)
    return signs.select("accession", F.array_sort("denied").alias("denied"), F.array_sort("affirmed").alias("affirmed"))


STANZA = """SELECT '[Term]' || chr(10) || 'id: X:' || p_name || chr(10) || 'name: ' || p_name || chr(10) || 'alt_id: Y:' || p_name || chr(10) || CASE WHEN p_name LIKE 'old %' THEN 'is_obsolete: true' || chr(10) ELSE '' END ||
 'is_a: X:' || split_part(p_name, ' ', 1) || ' ! first' || chr(10) || 'relationship: part_of X:' || split_part(p_name, ' ', 2) || ' ! second' || chr(10) || 'synonym: "' || split_part(p_name, ' ', 2) || ' thing" EXACT []' AS s FROM part
 UNION SELECT '[Term]' || chr(10) || 'id: X:' || split_part(p_name, ' ', 1) || chr(10) || 'name: ' || split_part(p_name, ' ', 1) FROM part WHERE p_name NOT LIKE 'red %'"""


def obo(t: Tables, name: str) -> DataFrame:
    """Terms of an ontology file whose ids are the part names without blanks; one file, as ontologies are."""
    p, path = t("part"), new(t("part"), name)
    s = p.sparkSession.sql(STANZA.replace("FROM part", "FROM {p}"), p=p.select(F.replace("p_name", F.lit(" "), F.lit(" ")).alias("p_name")))
    s = s.select(F.regexp_replace("s", r"(?m)^(id: X:|alt_id: Y:)(\S+) (\S+)$", "$1$2-$3").alias("s"))
    s.agg(F.concat(F.lit("format-version: 1.2\n\n"), F.array_join(F.array_sort(F.collect_list("s")), "\n\n"), F.lit("\n")).alias("value")).write.text(path)
    return R.obo_terms(p.sparkSession, path)


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part WHERE p_name NOT LIKE 'old %'), k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part WHERE p_name NOT LIKE 'red %')
SELECT 'X:' || a || '-' || b AS child, 'X:' || a AS parent, 'is_a' AS relation FROM n WHERE a IN (SELECT a FROM k)""")
def src12_ontology_edges(t):
    return R.obo_edges(obo(t, "obo"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name, 'X:' || split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) AS id, split_part(p_name, ' ', 2) || ' thing' AS synonym FROM part WHERE p_name NOT LIKE 'old %'),
a AS (SELECT name, id FROM n UNION SELECT synonym, id FROM n UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'X:' || split_part(p_name, ' ', 1) FROM part WHERE p_name NOT LIKE 'red %') SELECT name, min(id) AS id FROM a GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def src13_name_index(t):
    return R.name_index(obo(t, "names"))


@query("SELECT 'GO:' || p_partkey AS term, p_size / 4.0::DOUBLE AS weight FROM part WHERE p_size % 5 > 0")
def src14_weights(t):
    p, path = t("part"), new(t("part"), "weights")
    W.write_lines(p, F.concat(F.lit("GO:"), "p_partkey", F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("\t"), F.col("p_size") / 4.0)).otherwise(F.lit("\tnone"))), path)
    return R.read_weights(p.sparkSession, path)


@query("SELECT r_name AS name, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src15_indented_tree(t):
    n, path = t("nation"), new(t("nation"), "tree")
    both = t("region").select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("i"), F.col("r_name").alias("value")).unionByName(n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("i"), F.concat(F.lit("--"), "n_name").alias("value")))
    both.repartition(1).sortWithinPartitions("r", "i").select("value").write.text(path)  # a tree is one file
    return O.indent_tree(R.read_indented(n.sparkSession, path), "line_no", "depth", "name", "file")


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def src16_single_status(t):
    return R.single_status(t("lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT p_partkey, gene, value FROM (SELECT p_partkey, p_size::BIGINT AS g1, (p_size % 3)::BIGINT AS g2, (p_partkey % 2)::BIGINT AS g3 FROM part) UNPIVOT (value FOR gene IN (g1, g2, g3)) WHERE value <> 0")
def src19_long_expression(t):
    wide = t("part").select("p_partkey", F.col("p_size").cast("long").alias("g1"), (F.col("p_size") % 3).cast("long").alias("g2"), (F.col("p_partkey") % 2).alias("g3"))
    return R.long_expression(wide, "p_partkey", ["g1", "g2", "g3"])


@query("SELECT p_partkey, vec_id, len(embedding)::INT AS numbers FROM part JOIN embeddings ON sha1(p_partkey::VARCHAR) = sha1(vec_id::VARCHAR)")
def src20_vectors_by_content(t):
    rows = t("part").select("p_partkey", F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("sha"))
    vectors = t("embeddings").select("vec_id", F.sha1(F.col("vec_id").cast("string").cast("binary")).alias("sha"), "embedding")
    return rows.join(vectors, "sha").select("p_partkey", "vec_id", F.size("embedding").alias("numbers"))


@query("SELECT vec_id AS key, len(embedding)::INT AS numbers, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT))::BIGINT AS sum_e6 FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0")
def src20_array_shards(t):
    """All vectors written as array shards named by their content, and read back by ranges of rows."""
    e = t("embeddings")
    path = W.scratch(e.sparkSession, "arrays")
    N.write_arrays(e, "vec_id", "embedding", path)
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1e6).cast("long"))
    return N.read_keyed(e.sparkSession, path).select("key", F.size("vector").alias("numbers"), total.alias("sum_e6"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT label, count(*) AS rows FROM embeddings GROUP BY 1)
SELECT label, rows, count(*) AS numbers, sum((x <> 0)::INT)::BIGINT AS nonzero, sum((x < 0)::INT)::BIGINT AS negative, sum((x <> floor(x))::INT)::BIGINT AS fraction, sum((NOT isfinite(x))::INT)::BIGINT AS broken FROM x JOIN r USING (label) GROUP BY 1, 2""")
def src19_count_checks(t):
    return N.count_checks(t("embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector")), "label")


@query("SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1")
def snk1_appended(t):
    o, path = order_lines(t, "appended")
    W.write_jsonl(o.select("o_orderkey", "o_custkey", "o_orderstatus"), path, append=True)
    return R.read_strict(o.sparkSession, path, ORDER).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'rq1' AS figure, 'a' AS panel, o_orderstatus AS series, o_orderpriority AS x, count(*) AS n, count(*)::DOUBLE AS value FROM orders GROUP BY ALL")
def snk3_long_numbers(t):
    o, path = t("orders"), new(t("orders"), "numbers")
    counts = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    W.write_csv(W.all_metrics([W.metric_long(counts, "rq1", "a", "o_orderstatus", "o_orderpriority", "n", "n")]), path)
    return R.read_csv(o.sparkSession, path, W.METRIC).select("figure", "panel", "series", "x", "n", "value")


@query("""WITH c AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT '| r_name | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |' || chr(10), '' ORDER BY r_name) AS markdown,
'\\begin{tabular}{ll}' || chr(10) || 'r\\_name & n \\\\' || chr(10) || string_agg(r_name || ' & ' || n || ' \\\\' || chr(10), '' ORDER BY r_name) || '\\end{tabular}' || chr(10) AS latex FROM c""")
def snk4_reports(t):
    c = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n")).orderBy("r_name")
    return c.sparkSession.createDataFrame([(W.markdown(c), W.latex(c))], "markdown string, latex string")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem")
def snk5_packed_rows(t):
    li, path = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), new(t("lineitem"), "packed")
    W.write_csv(li, path, compressed=True)
    return R.read_csv(li.sparkSession, path, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def snk6_by_condition(t):
    o, path = t("orders"), new(t("orders"), "conditions")
    W.write_by_condition(o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("condition")), path)
    return R.read_strict(o.sparkSession, f"{path}/condition=O", "o_orderkey long, o_custkey long")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.input.seq'), 'none') AS seq FROM events")
def prj1_nested_fields(t):
    return t("events").select("event_id", C.nested(F.col("props"), "k", "none").alias("k"), C.nested(F.col("props"), "input.seq", "none").alias("seq"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def prj2_renamed_labels(t):
    return t("orders").select("o_orderkey", C.renamed(F.col("o_orderstatus"), {"F": "finished", "O": "open", "P": "partial"}).alias("status"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND user_id % 4 = 1")
def flt1_conditions_and_shard(t):
    return t("events").where(F.col("event_type").isin("view", "click") & (F.col("user_id") % 4 == 1)).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT l_partkey, list(DISTINCT l_returnflag) AS evidence FROM lineitem GROUP BY 1) SELECT p_partkey, p_name FROM part JOIN e ON p_partkey = l_partkey WHERE length(p_name) BETWEEN 8 AND 10 AND p_brand IS NOT NULL AND len(list_filter(evidence, lambda x: x IN ('A', 'N'))) > 0""")
def flt4_length_and_evidence(t):
    e = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_returnflag").alias("evidence"))
    curated = F.exists("evidence", lambda x: x.isin("A", "N"))
    return t("part").join(e, "p_partkey").where(F.length("p_name").between(8, 10) & F.col("p_brand").isNotNull() & curated).select("p_partkey", "p_name")


@query("WITH s AS (SELECT l_orderkey, l_suppkey, l_returnflag = 'A' AS y FROM lineitem) SELECT DISTINCT l_orderkey, l_suppkey, y FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM s GROUP BY 1 HAVING count(DISTINCT y) = 1)")
def flt6_one_sign(t):
    s = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_returnflag") == "A").alias("y")).distinct()
    one = s.groupBy("l_orderkey").agg(F.count_distinct("y").alias("n")).where("n = 1")
    return s.join(one, "l_orderkey", "left_semi")


@query(f"WITH {ARMS} SELECT a.arm, count(*) AS n, sum((a.pred IS DISTINCT FROM r.pred)::INT)::BIGINT AS violations FROM ans a JOIN ans r ON a.user_id = r.user_id AND r.arm = 'view' WHERE a.arm <> 'view' GROUP BY 1")
def chk1_unchanged_text(t):
    return C.unchanged(answers(t), "user_id", "arm", "view", "pred")


@query("WITH m AS (SELECT c_custkey, sha256(c_mktsegment || '|' || (c_nationkey % 5)) AS a, sha256(c_mktsegment || '|' || (c_nationkey % 4)) AS b, c_custkey % 3 = 0 AS absent FROM customer) SELECT sum((NOT absent AND a = b)::INT)::BIGINT AS same, sum((NOT absent AND a <> b)::INT)::BIGINT AS refused, sum(absent::INT)::BIGINT AS fresh FROM m")
def chk3_fingerprints(t):
    c = t("customer")
    now, then = (c.select("c_custkey", C.fingerprint(F.col("c_mktsegment"), (F.col("c_nationkey") % k).cast("string")).alias("mark")) for k in (5, 4))
    return C.resumable(now, then.where("c_custkey % 3 <> 0"), "c_custkey", "mark")


@query("""WITH x AS (SELECT c_custkey, c_name, unnest(string_split(c_name, '')) AS ch, unnest(range(0, length(c_name))) AS i FROM customer), s AS (SELECT c_custkey, any_value(c_name) AS a, string_agg(ch, '' ORDER BY md5(c_custkey || '|' || i), i) AS b FROM x GROUP BY 1)
SELECT c_custkey, list_sort(string_split(a, '')) = list_sort(string_split(b, '')) AS kept, len([i FOR i IN range(1, length(a) + 1) IF a[i] = b[i]])::BIGINT AS stayed, length(a)::BIGINT AS length FROM s""")
def chk4_shuffle_integrity(t):
    c = t("customer").select("c_custkey", "c_name", S.shuffled(F.col("c_name"), F.col("c_custkey").cast("string")).alias("shuffled"))
    return c.select("c_custkey", C.shuffle_integrity(F.col("c_name"), F.col("shuffled")).alias("x")).select("c_custkey", "x.*")
