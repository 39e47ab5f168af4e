"""Registered queries over texts: answers read from generations, prompts edited, texts compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions import text as T
from armwise.operators import ontology as O
from armwise.plans.catalog import EDGES, NORMAL, Tables, edges, query

# Generations: each conversation turn with an answer before or after its text, in an expression that both engines read.
SAID = """SELECT conv_id * 100 + turn AS k, coalesce(text, '') AS base, CASE (conv_id * 7 + turn * 3) % 9 WHEN 0 THEN 'The answer is (B).' WHEN 1 THEN ' a)'
 WHEN 2 THEN 'So B) it is, not A.' WHEN 3 THEN '<think>answer: A</think> Answer - b' WHEN 4 THEN 'Yes.' WHEN 5 THEN 'Nope, there is none; ref A -> var G'
 WHEN 6 THEN 'It is likely: C to T, or adenine to guanine. Answer: yes' WHEN 7 THEN 'Edit at 12: ref AC -> var G. Functional summary: it is G>A' ELSE '' END AS tail, conv_id % 2 AS side FROM conversations"""
RAW = "SELECT k, base, CASE WHEN side = 0 THEN tail || chr(10) || base ELSE base || chr(10) || tail END AS raw FROM said"
SAID_SQL = f"said AS ({SAID}), r AS ({RAW})"
SAID_W = r"[\p{L}\p{N}_]"


def said(t: Tables) -> DataFrame:
    c = t("conversations")
    return c.sparkSession.sql(RAW.replace("FROM said", "FROM {said}"), said=c.sparkSession.sql(SAID.replace("FROM conversations", "FROM {c}"), c=c))


def sql_words(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)')"


@query(f"WITH {SAID_SQL} SELECT k, {NORMAL.format('split_part(raw, chr(59), 1)')} AS gold FROM r")
def txt3_canonical_gold(t):
    return said(t).select("k", T.canonical_gold(F.col("raw")).alias("gold"))


UNORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s\-''/]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH {SAID_SQL}, t AS (SELECT k, split_part(base, ' ', 1) AS a, split_part(base, ' ', 2) AS b, replace(replace(raw, '</think>', ' '), '<think>', ' ') AS t FROM r),
m AS (SELECT *, regexp_extract_all(t, '(?i)\\banswer\\s*(?:is)?\\s*[:\\-]?\\s*\\(?([AB])\\)?\\b', 1)[-1] AS x, regexp_extract_all(t, '(?im)^\\s*(?:answer\\s*)?[:\\-]?\\s*\\(?([AB])\\)?\\s*[.):]?\\s*$', 1)[-1] AS y,
 regexp_extract_all(t, '(?:^|[^A-Za-z])\\(?([AB])\\)?[.):]', 1)[-1] AS z, a <> '' AND contains({UNORM.format('t')}, {UNORM.format('a')}) AS ha, b <> '' AND contains({UNORM.format('t')}, {UNORM.format('b')}) AS hb FROM t)
SELECT k, upper(coalesce(x, y, z, CASE WHEN ha AND NOT hb THEN 'A' WHEN hb AND NOT ha THEN 'B' END)) AS choice FROM m""")
def txt5_choice(t):
    a, b = (F.split_part("base", F.lit(" "), F.lit(i)) for i in (1, 2))
    return said(t).select("k", T.choice_ab(F.col("raw"), a, b).alias("choice"))


OPTED = """SELECT conv_id * 100 + turn AS k, [w1, w1 || ' ' || w2, lower(w2), 'CD4+ ' || w3] AS opts, CASE (conv_id + turn * 3) % 6 WHEN 0 THEN w1 WHEN 1 THEN ' ' || upper(w1) || '-' || upper(w2) || '.' WHEN 2 THEN 'surely ' || lower(w2) || ' here'
 WHEN 3 THEN 'cd4' WHEN 4 THEN '<b>cd4+_' || w3 || '</b>' ELSE 'none of these' || chr(10) || w1 END AS said FROM
 (SELECT conv_id, turn, split_part(text, ' ', 1) AS w1, split_part(text, ' ', 2) AS w2, split_part(text, ' ', 3) AS w3 FROM conversations WHERE text IS NOT NULL)"""
ONORM = r"trim(regexp_replace(regexp_replace(lower(trim({})), '[\s_\-]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s+]', '', 'g'))"


def opted(t: Tables) -> DataFrame:
    """OPTED on Spark: arrays by function, capitals letter by letter."""
    c = t("conversations")
    for i in (1, 2):
        c = c.withColumn(f"u{i}", T.upper_letters(F.split_part("text", F.lit(" "), F.lit(i))))
    sql = OPTED.replace("[w1", "array(w1").replace("w3] AS", "w3) AS").replace("upper(w1)", "u1").replace("upper(w2)", "u2")
    return c.sparkSession.sql(sql.replace("AS w3 FROM conversations", "AS w3, u1, u2 FROM {c}"), c=c)


ORACLE_SQL_OF_OPTIONS = f"""WITH o AS ({OPTED}), l AS (SELECT k, opts, trim(regexp_replace(trim(regexp_replace(split_part(trim(said), chr(10), 1), '<[^>]+>', '', 'g')), '^\\.+|\\.+$', '', 'g')) AS t FROM o),
p AS (SELECT *, {ONORM.format('t')} AS nt, [{ONORM.format('x')} FOR x IN opts] AS ns FROM l),
h AS (SELECT *, [i FOR i IN range(1, 5) IF opts[i] = t] AS ex, [i FOR i IN range(1, 5) IF nt <> '' AND ns[i] = nt] AS eq, [i FOR i IN range(1, 5) IF ns[i] <> '' AND contains(nt, ns[i])] AS held, [i FOR i IN range(1, 5) IF nt <> '' AND starts_with(ns[i], nt)] AS st FROM p),
g AS (SELECT *, [i FOR i IN held IF length(ns[i]) = list_max([length(ns[j]) FOR j IN held])] AS lg FROM h)
SELECT k, CASE WHEN len(ex) > 0 THEN opts[ex[1]] WHEN len(eq) > 0 THEN opts[eq[1]] WHEN len(held) = 1 THEN opts[held[1]] WHEN len(lg) = 1 THEN opts[lg[1]] WHEN len(st) = 1 THEN opts[st[1]] ELSE t END AS option,
 CASE WHEN len(ex) > 0 THEN 'exact' WHEN len(eq) > 0 THEN 'normalised' WHEN len(held) = 1 THEN 'contained' WHEN len(lg) = 1 THEN 'contained_longest' WHEN len(st) = 1 THEN 'prefix' ELSE 'none' END AS kind FROM g"""


@query(ORACLE_SQL_OF_OPTIONS)
def txt6_option(t):
    return opted(t).select("k", T.parsed_option(F.col("said"), F.col("opts")).alias("x")).select("k", "x.*")


@query(f"""WITH {SAID_SQL}, l AS (SELECT k, lower(raw) AS low, regexp_extract(lower(raw), '^[^a-z]*([a-z]+)', 1) AS w FROM r)
SELECT k, CASE WHEN w IN ('yes', 'no') THEN w WHEN {sql_words('low', 'yes')} AND NOT {sql_words('low', 'no')} THEN 'yes' WHEN {sql_words('low', 'no')} AND NOT {sql_words('low', 'yes')} THEN 'no' END AS answer FROM l""")
def txt8_yes_no_anywhere(t):
    return said(t).select("k", T.yes_no_anywhere(F.col("raw")).alias("answer"))


THOUGHT = "CASE WHEN regexp_matches(raw, '(?s)<think>(.*?)</think>') THEN regexp_extract(raw, '(?s)<think>(.*?)</think>', 1) END"


@query(f"""WITH {SAID_SQL} SELECT k, {THOUGHT} AS thought, coalesce(regexp_replace(nullif(regexp_extract(raw, '(?is)functional summary:?\\s*(.*)', 1), ''), '^\\s+|\\s+$', '', 'g'),
 substr(regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 1500)) AS summary FROM r""")
def txt10_thought_and_summary(t):
    return said(t).select("k", T.thought(F.col("raw")).alias("thought"), T.summary_part(F.col("raw")).alias("summary"))


@query(f"WITH {SAID_SQL} SELECT k, coalesce({THOUGHT}, split_part(raw, 'Answer:', 1)) AS trace FROM r")
def txt11_trace(t):
    return said(t).select("k", T.trace(F.col("raw")).alias("trace"))


# Each pattern after what stands before it, whose length is its place; groups 2 and 3 are the bases.
_PAIRS = [r"(?:^|[^\p{L}\p{N}_]))([ACGT])>([ACGT])(?:[^\p{L}\p{N}_]|$)", r")ref\s*([ACGT])\s*->\s*var\s*([ACGT])", r"(?:^|[^A-Za-z0-9]))([ACGT])\s*(?:->|-->|→|>)\s*([ACGT])(?:[^A-Za-z0-9]|$)",
          r"(?:^|[^A-Za-z0-9]))([ACGT])\s+(?:to|into)\s+([ACGT])(?:[^A-Za-z0-9]|$)", r"(?:^|[^\p{L}\p{N}_]))(adenine|thymine|cytosine|guanine)\s*(?:>|->|→|\s+to\s+|\s+into\s+)\s*(adenine|thymine|cytosine|guanine)(?:[^\p{L}\p{N}_]|$)"]
_MADE = ", ".join(f"CASE WHEN regexp_matches(raw, '(?s{'i' if i == 4 else ''})^(.*?{p}') THEN {{'at': length(regexp_extract(raw, '(?s{'i' if i == 4 else ''})^(.*?{p}', 1)), 'i': {i}, 'a': regexp_extract(raw, '(?s{'i' if i == 4 else ''})^(.*?{p}', 2), 'b': regexp_extract(raw, '(?s{'i' if i == 4 else ''})^(.*?{p}', 3)}} END" for i, p in enumerate(_PAIRS))
_BASE = "CASE lower({0}) WHEN 'adenine' THEN 'A' WHEN 'thymine' THEN 'T' WHEN 'cytosine' THEN 'C' WHEN 'guanine' THEN 'G' ELSE {0} END"


@query(f"WITH {SAID_SQL}, f AS (SELECT k, list_filter([{_MADE}], lambda x: x IS NOT NULL) AS f FROM r), g AS (SELECT k, list_min(f) AS e, list_min([{{'i': x.i, 'a': x.a, 'b': x.b}} FOR x IN f]) AS l FROM f) SELECT k, {_BASE.format('e.a')} || '>' || {_BASE.format('e.b')} AS earliest, {_BASE.format('l.a')} || '>' || {_BASE.format('l.b')} AS listed FROM g")
def txt12_stated_pair(t):
    return said(t).select("k", T.stated_pair(F.col("raw")).alias("earliest"), T.stated_pair(F.col("raw"), earliest=False).alias("listed"))


_EDIT = "regexp_extract(raw, 'Edit at (\\d+): ref ([A-Za-z\\-]+) -> var ([A-Za-z\\-]+)', {})"


@query(f"WITH {SAID_SQL} SELECT k, try_cast(nullif({_EDIT.format(1)}, '') AS BIGINT) AS place, nullif({_EDIT.format(2)}, '') AS ref, nullif({_EDIT.format(3)}, '') AS var FROM r")
def txt13_stated_edit(t):
    return said(t).select("k", T.stated_edit(F.col("raw")).alias("e")).select("k", "e.*")


BLOCKS = "SELECT p_partkey, 'GO:9999999 comes first' || chr(10) || 'Biological process:' || chr(10) || 'GO:' || lpad(CAST(p_partkey AS STRING), 7, '0') || ', GO:0000001' || chr(10) || ' Function: ' || chr(10) || 'GO:' || lpad(CAST(p_size AS STRING), 7, '0') || ' GO:0000001' AS said FROM part"


@query(f"""WITH b AS ({BLOCKS}), l AS (SELECT p_partkey, unnest(string_split(said, chr(10))) AS line, unnest(range(0, len(string_split(said, chr(10))))) AS i FROM b),
a AS (SELECT p_partkey, line, last_value(CASE WHEN regexp_matches(trim(line), '^[A-Za-z ]+:$') THEN lower(regexp_replace(trim(line), ':$', '')) END IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY i) AS aspect FROM l)
SELECT DISTINCT p_partkey, aspect, unnest(regexp_extract_all(line, 'GO:\\d{{7}}')) AS term FROM a""")
def txt14_block_terms(t):
    p = t("part")
    return T.block_terms(p.sparkSession.sql(BLOCKS.replace("FROM part", "FROM {p}"), p=p), "p_partkey", "said")


@query("""WITH w AS (SELECT conv_id, turn, [regexp_replace(upper(x), '\\.+$', '') FOR x IN regexp_extract_all(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[A-Za-z0-9][A-Za-z0-9\\-\\.]*')] AS w FROM conversations)
SELECT conv_id, turn, [w[i] FOR i IN range(1, len(w) + 1) IF w[i] IN ('LA', 'DE', 'THE', 'QUE', 'OF', 'EL') AND list_position(w, w[i]) = i] AS cited FROM w""")
def txt15_cited_terms(t):
    vocabulary = F.array(*[F.lit(x) for x in ("LA", "DE", "THE", "QUE", "OF", "EL")])
    return t("conversations").select("conv_id", "turn", T.cited_terms(F.coalesce("text", F.lit("")), vocabulary).alias("cited"))


@query(f"WITH {SAID_SQL} SELECT k, trim(regexp_replace(split_part(regexp_replace(split_part(' Cell type: ' || raw, 'answer', 1), '^\\s+|\\s+$', '', 'g'), chr(10), 1), '(?i)^\\s*cell type:\\s*', ''), ' ' || chr(9) || chr(13)) AS label FROM r")
def txt16_predicted_label(t):
    return said(t).select("k", T.predicted_type(F.concat(F.lit(" Cell type: "), F.replace(F.col("raw"), F.lit("answer"), F.lit("Rationale:")))).alias("label"))


@query("SELECT p_partkey, string_split_regex(regexp_replace(p_name || ' ' || p_type || '..', '\\.+$', ''), '\\s+') AS genes FROM part")
def txt17_listed_genes(t):
    prompt = F.concat(F.lit("Type of cell? Cell sentence: "), "p_name", F.lit(" "), "p_type", F.lit(".."), F.lit("\nNext line."))
    return t("part").select("p_partkey", T.listed_genes(prompt).alias("genes"))


@query(f"""WITH {EDGES}, m AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS gold, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a:' || split_part(p_name, ' ', 1) WHEN 2 THEN 'root' ELSE 'n:bolt' END AS pred FROM part)
SELECT p_partkey, (CASE WHEN gold IS NOT NULL THEN pred = gold END)::INT AS fine, (CASE WHEN gold IS NOT NULL THEN pred = gold OR EXISTS (SELECT 1 FROM closed WHERE term = gold AND ancestor = pred AND distance > 0) END)::INT AS coarse FROM m""")
def txt19_fine_and_coarse(t):
    gold = F.when(F.col("p_size") % 7 != 0, F.col("p_name"))
    k = F.col("p_partkey") % 4
    pred = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("a:"), F.split_part("p_name", F.lit(" "), F.lit(1)))).when(k == 2, "root").otherwise("n:bolt")
    return O.matched_type(t("part").select("p_partkey", gold.alias("gold"), pred.alias("pred")), O.closure(edges(t)), "pred", "gold").select("p_partkey", F.col("fine").cast("int").alias("fine"), F.col("coarse").cast("int").alias("coarse"))


@query("""WITH l AS (SELECT l_orderkey AS k, string_agg(p_name || CASE WHEN l_linenumber % 2 = 0 THEN 's' ELSE '' END || CASE WHEN l_linenumber = 3 THEN ' (Bolts!)' ELSE '' END, ', and ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
w AS (SELECT k, [lower(x) FOR x IN regexp_extract_all(t, '[A-Za-z0-9+\\-]+')] AS w, regexp_extract_all(t, '[A-Za-z0-9+\\-]+') AS raw FROM l), i AS (SELECT k, w, raw, unnest(range(1, len(w) + 1)) AS i FROM w),
v AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
h AS (SELECT k, raw, i, n, w[i:i + n - 1] AS g FROM i, range(1, 3) r(n) WHERE i + n - 1 <= len(w)), c AS (SELECT k, raw, i, n, coalesce(a.phrase, b.phrase) AS phrase FROM (SELECT *, array_to_string(g, ' ') AS p FROM h) LEFT JOIN v a ON a.phrase = p LEFT JOIN v b ON p LIKE '%s' AND b.phrase = p[:-2] WHERE a.phrase IS NOT NULL OR b.phrase IS NOT NULL)
SELECT k, i::INT AS start, n::INT AS size, array_to_string(raw[i:i + n - 1], ' ') AS span, phrase AS id FROM c WHERE n = 2 OR NOT EXISTS (SELECT 1 FROM c d WHERE d.k = c.k AND d.n = 2 AND c.i IN (d.i, d.i + 1))""")
def txt20_vocabulary_terms(t):
    said = F.concat("p_name", F.when(F.col("l_linenumber") % 2 == 0, "s").otherwise(""), F.when(F.col("l_linenumber") == 3, " (Bolts!)").otherwise(""))
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", said.alias("t")))).alias("s"))
    names = t("part").select(F.col("p_name").alias("name")).union(t("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    index = T.vocabulary_index(names.select(F.col("name").alias("id"), "name", F.array().cast("array<string>").alias("synonyms")))
    return T.vocabulary_terms(rows, "k", F.array_join(F.transform("s", lambda x: x["t"]), ", and "), index)


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_brand END AS gene FROM part")
def txt22_stem_gene(t):
    stem = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("What is the effect of this "), "p_brand", F.lit(" allele on it?"))).otherwise("What is the effect of it?")
    return t("part").select("p_partkey", T.stem_gene(stem).alias("gene"))


@query("SELECT p_partkey, 'head' || CASE WHEN 20 / p_size::DOUBLE >= 0.8 THEN '' ELSE chr(10) || 'IPR1 ' || p_name || ' [1-20]' END || CASE WHEN 2 / p_size::DOUBLE >= 0.8 THEN '' ELSE chr(10) || 'IPR2 part [3-4]' END AS kept FROM part")
def txt23_long_entries_removed(t):
    lines = F.concat(F.lit("head\nIPR1 "), "p_name", F.lit(" [1-20]\nIPR2 part [3-4]"))
    return t("part").select("p_partkey", T.without_long_entries(lines, F.col("p_size")).alias("kept"))


@query("SELECT p_partkey, 'Which ' || p_type || '?' || chr(10) || 'A) ' || p_name || chr(10) || 'B) ' || p_brand AS prompt FROM part")
def txt24_option_prompt(t):
    return t("part").select("p_partkey", T.option_prompt(F.concat(F.lit("Which "), "p_type", F.lit("?")), F.array("p_name", "p_brand")).alias("prompt"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('A ' || upper(p_name) || ' and bolts, ' || p_brand, '(?i)\\bred bolt\\b', 'it', 'g'), '(?i)\\bbolt\\b', 'it', 'g'), '(?i)\\bred\\b', 'it', 'g') AS told,
contains(lower('A ' || upper(p_name)), 'red') OR contains(lower('A ' || upper(p_name)), 'bolt') AS leaks FROM part""")
def txt25_names_removed(t):
    names = F.array(F.lit("red"), F.lit("bolt"), F.lit("red bolt"))
    x = F.concat(F.lit("A "), F.upper("p_name"))
    return t("part").select("p_partkey", T.without_names(F.concat(x, F.lit(" and bolts, "), "p_brand"), names, "it").alias("told"), T.leaks(x, names).alias("leaks"))


@query("""WITH f AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS f FROM orders GROUP BY 1)
SELECT o_custkey, CASE len(f) WHEN 1 THEN f[1] WHEN 2 THEN f[1] || ' and ' || f[2] ELSE array_to_string(f[1:least(len(f), 4) - 1], ', ') || ', and ' || f[least(len(f), 4)] END AS facts FROM f""")
def txt26_enumerated(t):
    held = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("f"))
    return held.select("o_custkey", T.enumerated(F.col("f"), 4).alias("facts"))


_GRAMS = "SELECT 'g' AS s, k, n, [array_to_string(g[i:i + n - 1], ' ') FOR i IN range(1, len(g) - n + 2)] AS x FROM w, range(1, 5) r(n) UNION ALL SELECT 'h', k, n, [array_to_string(h[i:i + n - 1], ' ') FOR i IN range(1, len(h) - n + 2)] FROM w, range(1, 5) r(n)"


@query(f"""WITH w AS (SELECT p_partkey AS k, string_split(lower(p_name || ' of ' || p_type || ' and ' || p_name), ' ') AS g, string_split(lower('the ' || p_name || ' of ' || p_brand || ' and ' || p_type), ' ') AS h FROM part),
e AS (SELECT s, k, n, unnest(x) AS gram FROM ({_GRAMS})), c AS (SELECT s, k, n, gram, count(*) AS c FROM e GROUP BY ALL)
SELECT g.n::INT AS n, sum(least(g.c, coalesce(h.c, 0)))::BIGINT AS clipped, sum(g.c)::BIGINT AS grams FROM c g LEFT JOIN c h ON h.s = 'h' AND h.k = g.k AND h.n = g.n AND h.gram = g.gram WHERE g.s = 'g' GROUP BY 1""")
def txt27_bleu_counts(t):
    guess = F.concat_ws(" ", "p_name", F.lit("of"), "p_type", F.lit("and"), "p_name")
    gold = F.concat_ws(" ", F.lit("the"), "p_name", F.lit("of"), "p_brand", F.lit("and"), "p_type")
    return T.bleu_counts(t("part").select("p_partkey", guess.alias("guess"), gold.alias("gold")), "p_partkey", "guess", "gold")


@query()
def txt27_rouge_l(t):
    """Every turn against the one before it."""
    c = t("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return T.rouge_l(c.select("conv_id", "turn", "text").join(before, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "before")


@query(f"""WITH w AS (SELECT p_partkey AS k, string_split(lower(p_name || ' of ' || p_type || ' and ' || p_name), ' ') AS g, string_split(lower('the ' || p_name || ' of ' || p_brand || ' and ' || p_type), ' ') AS h FROM part),
e AS (SELECT s, k, n, unnest(x) AS gram FROM ({_GRAMS})), c AS (SELECT s, k, n, gram, count(*) AS c FROM e GROUP BY ALL),
b AS (SELECT g.n AS n, sum(least(g.c, coalesce(h.c, 0))) / sum(g.c)::DOUBLE AS p FROM c g LEFT JOIN c h ON h.s = 'h' AND h.k = g.k AND h.n = g.n AND h.gram = g.gram WHERE g.s = 'g' GROUP BY 1), l AS (SELECT sum(len(g))::BIGINT AS g, sum(len(h))::BIGINT AS h FROM w)
SELECT any_value(l.g) AS guess_words, any_value(l.h) AS gold_words, round(any_value(least(1, exp(1 - l.h / l.g::DOUBLE))) * 1e9)::BIGINT AS brevity_e9, round(any_value(least(1, exp(1 - l.h / l.g::DOUBLE))) * exp(avg(ln(p))) * 1e9)::BIGINT AS bleu_e9 FROM b, l""")
def txt27_corpus_bleu(t):
    guess = F.concat_ws(" ", "p_name", F.lit("of"), "p_type", F.lit("and"), "p_name")
    gold = F.concat_ws(" ", F.lit("the"), "p_name", F.lit("of"), "p_brand", F.lit("and"), "p_type")
    out = T.corpus_bleu(t("part").select("p_partkey", guess.alias("guess"), gold.alias("gold")), "p_partkey", "guess", "gold")
    return out.select("guess_words", "gold_words", F.round(F.col("brevity") * 1e9).cast("long").alias("brevity_e9"), F.round(F.col("bleu") * 1e9).cast("long").alias("bleu_e9"))


@query("""WITH x AS (SELECT conv_id, turn, chr(9) || ' ' || coalesce(text, '') || chr(10) || ' ' AS x FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS stripped FROM x)
SELECT conv_id, turn, stripped, split_part(stripped, chr(10), 1) AS line, string_split(stripped, ' ')[-1] AS last_word FROM s""")
def txt28_strip_and_split(t):
    s = T.strip(F.concat(F.lit("\t "), F.coalesce("text", F.lit("")), F.lit("\n ")))
    return t("conversations").select("conv_id", "turn", s.alias("stripped"), T.first_line(s).alias("line"), T.after_last(s, " ").alias("last_word"))
