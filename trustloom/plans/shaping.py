"""Queries over datasets and texts: loading, clean-up, parsers of claims, sentences, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import text as T
from trustloom.functions import verdicts as V
from trustloom.operators import judging as J
from trustloom.plans.registry import query
from trustloom.plans.sql import R1
from trustloom.sources import asking as A
from trustloom.sources import bindings as B
from trustloom.sources import datasets as D


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else q(v) for v in r) + ")" for r in rows)


@query("dataset_names", "S1", f"SELECT * FROM (VALUES {values([(n,) for n in D.NAMES])}) t(name)")
def dataset_names(spark, d):
    return D.list_datasets(spark)


@query("load_dataset", "S2 S4 P1 P8", "SELECT p_partkey AS id, p_name AS question, p_type AS answer FROM part ORDER BY p_partkey LIMIT 500")
def load_dataset(spark, d):
    return D.load(spark, f"{d}/part.parquet", n=500, cols=["id", "question", "answer", "absent"], rename={"p_partkey": "id", "p_name": "question", "p_type": "answer"}, order=["id"])


@query("union_splits", "S3", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_splits(spark, d):
    a = B.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")
    return D.all_splits([a, B.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")])


@query("parse_answer_lists", "S5", "SELECT p_partkey AS id, unnest([p_brand, p_type]) AS answer FROM part")
def parse_answer_lists(spark, d):
    text = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("possible_answers")).select("id", F.explode(T.parsed_list(F.col("possible_answers"))).alias("answer"))


@query("longest_by_category", "S6", "SELECT doc_id, lang, n FROM (SELECT doc_id, lang, length(text)::INT AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE length(text) > 0) WHERE r <= 100")
def longest_by_category(spark, d):
    return D.longest_by_category(B.table(spark, d, "documents"), "lang", "text", "doc_id").select("doc_id", "lang", F.length("text").alias("n"))


@query("flatten_categories", "S7", "SELECT r_name AS entity_type, n_name AS entity, 'Tell me a bio of ' || n_name AS question FROM region JOIN nation ON r_regionkey = n_regionkey")
def flatten_categories(spark, d):
    rows = B.table(spark, d, "region").join(B.table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("entities"))
    return D.flattened(rows, "r_name", "entities")


def echo(prompts: list[str]) -> list[str]:
    """A client that answers with the prompt's last word."""
    return [p.split(" ")[-1] for p in prompts]


@query("generate_responses", "S8 S9 S12", "SELECT p_partkey AS prompt_id, unnest(range(3))::INT AS sample_idx, string_split(p_name, ' ')[-1] AS text FROM part")
def generate_responses(spark, d):
    prompts = B.table(spark, d, "part").selectExpr("p_partkey AS prompt_id", "p_name AS prompt")
    return D.generate(prompts, echo, count=3)


class Echo:
    """A client that answers with the prompt's last word, after a first failure, and refuses some prompts for good."""

    temperature = 1.0

    def __init__(self):
        self.tried = set()

    async def ask(self, messages: list[dict], top_logprobs: int | None = None) -> dict:
        text = messages[-1]["content"]
        if text not in self.tried:
            self.tried.add(text)
            raise ConnectionError("busy")
        if text.startswith("a"):
            raise PermissionError("refused")
        if top_logprobs:
            raise TypeError("no top_logprobs here")
        return {"content": text.split(" ")[-1], "metadata": {"logprobs": {"tokens": ["x"], "token_logprobs": [-0.5]}}}


@query("asked_responses", "S8 S10 S12 S16", """SELECT p_partkey AS prompt_id, unnest(range(2))::INT AS sample_idx, CASE WHEN p_name LIKE 'a%' THEN NULL ELSE string_split(p_name, ' ')[-1] END AS text,
 CASE WHEN p_name LIKE 'a%' THEN NULL ELSE -0.5::DOUBLE END AS logprob, CASE WHEN p_name LIKE 'a%' THEN 'PermissionError: refused' END AS error FROM part""")
def asked_responses(spark, d):
    prompts = B.table(spark, d, "part").selectExpr("p_partkey AS prompt_id", "p_name AS prompt")
    rows = A.ask(prompts, Echo, count=2, top_logprobs=5, retries=2, pause=0.0, errors="keep")
    return rows.select("prompt_id", "sample_idx", "text", F.get(D.normalized_logprobs(F.col("metadata"))["logprob"], F.lit(0)).alias("logprob"), "error")


@query("provider_settings", "S19", "SELECT * FROM (VALUES ('temperature', '0.3'), ('max_tokens', '64')) t(name, value)")
def provider_settings(spark, d):
    from trustloom.sources import providers

    class Client:
        def __init__(self, temperature, max_tokens):
            self.temperature, self.max_tokens, self.api_key, self.base_url = temperature, max_tokens, "k", "http://localhost"

    again = providers.restored(providers.saved_settings(Client(0.3, 64)))
    held = providers.saved_settings(again)
    return spark.createDataFrame([(k, str(v)) for k, v in held.items() if k not in ("class_name", "module")], "name string, value string")


@query("prompt_batches", "S9 S10", "SELECT batch, count(*)::BIGINT AS calls FROM (SELECT p_partkey // 12 AS batch, unnest(range(5)) AS copy FROM part) GROUP BY 1")
def prompt_batches(spark, d):
    prompts = D.batched(B.table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k", D.batch_size(60, 5))
    return D.duplicated(prompts, 5).groupBy("batch").agg(F.count("*").alias("calls"))


@query("prompt_messages", "S11 D1", "SELECT p_partkey AS id, r.role, CASE r.role WHEN 'system' THEN 'You are a helpful assistant.' ELSE p_name END AS content FROM part, (VALUES ('system'), ('user')) r(role)")
def prompt_messages(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(D.messages(F.col("p_name"))).alias("m"))
    return rows.select("id", "m.role", "m.content")


@query("normalize_logprobs", "S13", "SELECT event_id, 'a' AS token, round(value, 3) AS logprob FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 'b', -1.5::DOUBLE FROM events WHERE event_id % 4 <> 3")
def normalize_logprobs(spark, d):
    v, k = F.round("value", 3).cast("string"), F.col("event_id") % 4
    pair = F.concat(F.lit('[{"token":"a","logprob":'), v, F.lit('},{"token":"b","logprob":-1.5}]'))
    raw = F.when(k == 0, F.concat(F.lit('{"logprobs":{"content":'), pair, F.lit("}}"))).when(k == 1, F.concat(F.lit('{"logprobs_result":'), pair, F.lit("}"))).when(k == 2, F.concat(F.lit('{"logprobs":{"tokens":["a","b"],"token_logprobs":['), v, F.lit(",-1.5]}}"))).otherwise("{}")
    rows = B.table(spark, d, "events").select("event_id", F.explode(D.normalized_logprobs(raw)).alias("x"))
    return rows.select("event_id", "x.token", "x.logprob")


@query("postprocess_responses", "S14 F6", f"WITH {R1} SELECT prompt_id, text AS raw_response, lower(text) AS response FROM r1 WHERE sample_idx = 0")
def postprocess_responses(spark, d):
    rows = B.responses(spark, d).where("sample_idx = 0")
    return rows.select("prompt_id", F.col("text").alias("raw_response"), F.lower("text").alias("response"))


@query("regroup_samples", "S15", f"WITH {R1} SELECT prompt_id, any_value(text) FILTER (sample_idx = 0) AS response, string_agg(text, ',' ORDER BY sample_idx) FILTER (sample_idx > 0) AS samples FROM r1 GROUP BY 1")
def regroup_samples(spark, d):
    return D.regrouped_samples(B.responses(spark, d)).select("prompt_id", "response", F.array_join("sampled_responses", ",").alias("samples"))


@query("result_frame", "S17 P8", f"WITH {R1} SELECT prompt_id, text AS response, length(text)::INT AS entropy_value FROM r1 WHERE sample_idx = 0")
def result_frame(spark, d):
    return D.singular(B.responses(spark, d).where("sample_idx = 0").select(F.col("text").alias("responses"), F.length("text").alias("entropy_values"), "prompt_id"))


@query("clean_columns", "P2 P3 P4 P5 P7", """SELECT p_partkey AS id, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, replace(p_name, ' ', '') AS joined, upper(p_type) AS loud, lower(p_brand) || ',' || lower(p_type) AS soft,
 CASE WHEN regexp_matches(p_brand, '#(\\d)') THEN regexp_extract(p_brand, '#(\\d)', 1) ELSE p_brand END AS found FROM part""")
def clean_columns(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("digits"), F.col("p_name").alias("joined"), F.col("p_type").alias("loud"), F.array("p_brand", "p_type").alias("soft"), F.col("p_brand").alias("found"))
    out = D.processed(rows, [("digits_only", "digits"), ("remove_spaces", "joined"), ("upper", "loud"), ("lower", "soft"), ("search", "found", (r"#(\d)", 1))])
    return out.withColumn("soft", F.array_join("soft", ","))


@query("question_choices", "P6", "SELECT p_partkey AS id, p_name || ' A) ' || p_brand || ' B) ' || p_type AS question FROM part")
def question_choices(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.question_with_choices(F.col("p_name"), F.array(F.lit("A"), F.lit("B")), F.array("p_brand", "p_type")).alias("question"))


@query("integer_part", "P9", "SELECT event_id, regexp_replace(split_part('the answer is $' || (round(value * 100) / 100)::VARCHAR || ' or so', '.', 1), '[^0-9]', '', 'g') AS answer FROM events")
def integer_part(spark, d):
    text = F.concat(F.lit("the answer is $"), (F.round(F.col("value") * 100) / 100).cast("string"), F.lit(" or so"))
    return B.table(spark, d, "events").select("event_id", T.integer_part(text).alias("answer"))


@query("claims_fields", "P10", "SELECT l_orderkey AS id, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS claims FROM lineitem GROUP BY 1")
def claims_fields(spark, d):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("claim"))
    data = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("claims_data"))
    return data.select("id", F.array_join(F.col("claims_data.claim"), "").alias("claims"))


FENCED = [(1, "a ```python\nx = 1\n``` b ```\nlonger = 2\n```"), (2, "`print(1)`"), (3, "```py\nif a &lt; b:\r\n  c()\n```"), (4, None), (5, "half ```open"), (6, "```\nab\n``` and ```\ncd\n```")]


@query("code_fences", "P11", f"SELECT * FROM (VALUES {values([(1, 'longer = 2'), (2, 'print(1)'), (3, None), (4, ''), (5, 'half open'), (6, 'ab')])}) t(id, code)".replace("(3, NULL)", "(3, 'if a < b:' || chr(10) || '  c()')"))
def code_fences(spark, d):
    return spark.createDataFrame(FENCED, "id int, raw string").select("id", T.code_of(F.col("raw")).alias("code"))


@query("truncated_texts", "P12", "SELECT doc_id, left(text, 2000) AS text FROM documents")
def truncated_texts(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.truncated(F.col("text")).alias("text"))


@query("test_cases", "P13", "SELECT p_partkey AS id, unnest([p_brand, p_type]) AS input, unnest([p_size::VARCHAR, p_name]) AS output FROM part")
def test_cases(spark, d):
    case = lambda a, b: F.struct(a.alias("input"), b.alias("output"))
    text = F.to_json(F.array(case(F.col("p_brand"), F.col("p_size").cast("string")), case(F.col("p_type"), F.col("p_name"))))
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(T.parsed_cases(text)).alias("c"))
    return rows.select("id", "c.input", "c.output")


@query("sentences", "P14 L1", f"""WITH a AS (SELECT doc_id, regexp_replace(text, '(\\d+)\\.(\\d+)', '\\1<DOT>\\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, {"regexp_replace(" * len(T.ABBREVIATIONS)}t{"".join(f", '(?i)(^|[^\\p{{L}}\\p{{N}}_])({x.split('.')[0]}){'.' .replace('.', '\\.') + '(' + x.split('.')[1] + ')' if '.' in x else ''}\\.', '\\1\\2<DOT>{'\\3<DOT>' if '.' in x else ''}', 'g')" for x in sorted(T.ABBREVIATIONS, key=len, reverse=True))} AS t FROM a),
c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-Z])', '\\1<SPLIT>\\2', 'g'), '<SPLIT>') AS p FROM b)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS sentence_idx, replace(unnest(p), '<DOT>', '.') AS sentence FROM c""")
def sentences(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_idx", "sentence"))


@query("claims", "P15 P16 L1", """SELECT l_orderkey AS id, g - 1 AS claim_idx, CASE g WHEN 1 THEN 'first ' || l_returnflag ELSE 'second of ' || l_linestatus END AS claim
FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem), (VALUES (1), (2)) t(g) WHERE l_orderkey % 3 <> 0""")
def claims(spark, d):
    text = F.when(F.col("l_orderkey") % 3 == 0, F.lit("### NONE")).otherwise(F.concat(F.lit("Here:\n###   first   "), F.col("l_returnflag"), F.lit("\n\n### second of "), F.col("l_linestatus"), F.lit("\n###  \n")))
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").distinct()
    return rows.select(F.col("l_orderkey").alias("id"), F.posexplode(T.claims(text)).alias("claim_idx", "claim"))


@query("bullets_and_questions", "P17 P18", "SELECT n_nationkey AS id, n_name || ' is one' AS bullet, 2 AS n_questions FROM nation")
def bullets_and_questions(spark, d):
    b = T.bullets(F.concat(F.lit("New:\n - "), F.col("n_name"), F.lit(" is one\nnot - this")))
    n = F.size(T.questions(F.concat(F.lit("###Who?"), F.lit("###What is "), F.col("n_name"))))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(b).alias("bullet"), n.alias("n_questions"))


def ordered_case(c: str, buckets) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {q(p)})' for p in ps)} THEN {s}::DOUBLE" for s, ps in buckets) + " END"


VERDICTS = """v AS (SELECT event_id // 5 AS prompt_id, (event_id % 5)::INT AS judge_id, CASE event_type WHEN 'click' THEN 'Correct.' WHEN 'view' THEN 'The answer is incorrect' WHEN 'purchase' THEN ' I am NOT SURE '
 WHEN 'signup' THEN 'Score: ' || (event_id % 120) ELSE (event_id % 7) || ' of it' END AS raw_text FROM events)"""


@query("judge_verdicts", "V1 V2 V3 V4 V6 D2", f"""WITH {VERDICTS}, n AS (SELECT *, lower(raw_text) AS t, trim(lower(raw_text)) AS s, try_cast(regexp_replace(raw_text, '[^0-9]', '', 'g') AS DOUBLE) AS k FROM v)
SELECT prompt_id, judge_id, {ordered_case('t', V.TERNARY)} AS tfu, {ordered_case('t', (V.TERNARY[0], V.TERNARY[2]))} AS tf, CASE WHEN k BETWEEN 0 AND 100 THEN k / 100 END AS cont, {ordered_case('s', V.LIKERT)} AS likert FROM n""")
def judge_verdicts(spark, d):
    c = F.col("raw_text")
    return B.verdicts(spark, d).select("prompt_id", "judge_id", V.ternary(c).alias("tfu"), V.binary(c).alias("tf"), V.continuous(c).alias("cont"), V.likert(c).alias("likert"))


@query("structured_verdicts", "V5", f"""WITH {VERDICTS}, s AS (SELECT prompt_id, judge_id, 'Score: ' || raw_text || CASE WHEN judge_id % 2 = 0 THEN chr(10) || 'Explanation: because ' || judge_id ELSE '' END AS t FROM v)
SELECT prompt_id, judge_id, trim(split_part(split_part(t, 'Score:', 2), 'Explanation:', 1), ' ' || chr(10)) AS answer, CASE WHEN judge_id % 2 = 0 THEN 'because ' || judge_id ELSE 'No explanation provided' END AS explanation FROM s WHERE NOT contains(t, 'Score: Score')""")
def structured_verdicts(spark, d):
    text = F.concat(F.lit("Score: "), F.col("raw_text"), F.when(F.col("judge_id") % 2 == 0, F.concat(F.lit("\nExplanation: because "), F.col("judge_id"))).otherwise(""))
    rows = B.verdicts(spark, d).where("NOT contains(raw_text, 'Score:')").select("prompt_id", "judge_id", V.structured(text).alias("s"))
    return rows.select("prompt_id", "judge_id", "s.answer", "s.explanation")


SAID = [
    (1, "Fairly possible."), (2, "I think: almost certain, no chance"), (3, "LITTLE CHANCE"), (4, "dunno"), (5, "yes, it does"), (6, "No"), (7, "well yes"), (8, "Not-equivalent"), (9, "They behave the same"), (10, "different output here"), (11, None), (12, "Equivalent"), (13, "subjective"), (14, "objective"),
]


@query("worded_verdicts", "V7 V8 V9 V10 V11 D5 D7 D8 D9", f"""SELECT id, conf::DOUBLE AS confidence, ent::DOUBLE AS entails, (yes = 1) AS yes, (obj = 1) AS objective, eq::DOUBLE AS equivalent FROM (VALUES
 {values([(1, 0.6, None, 0, 0, None), (2, 1.0, 0, 0, 0, None), (3, 0.2, None, 0, 0, None), (4, None, 0, 0, 0, None), (5, None, 1, 1, 0, None), (6, None, 0, 0, 0, None), (7, None, 1, 1, 0, None), (8, None, 0, 0, 0, 0), (9, None, None, 0, 0, 1), (10, None, None, 0, 0, 0), (11, None, None, 0, 0, None), (12, None, None, 0, 0, 1), (13, None, None, 0, 0, None), (14, None, None, 0, 1, None)])}) t(id, conf, ent, yes, obj, eq)""")
def worded_verdicts(spark, d):
    c = F.col("raw")
    rows = spark.createDataFrame(SAID, "id int, raw string")
    return rows.select("id", V.verbal_confidence(c).alias("confidence"), V.entails(c).alias("entails"), V.says_yes(c).alias("yes"), V.is_objective(c).alias("objective"), V.equivalence(c).alias("equivalent"))


@query("p_true", "V12 W12", "SELECT l_orderkey AS id, l_linenumber AS k, l_partkey AS p, l_suppkey AS s, round(CASE l_returnflag WHEN 'A' THEN exp(ln(1 - l_discount)) WHEN 'N' THEN 1 - exp(ln(1 - l_discount)) END, 6) AS p_true FROM lineitem")
def p_true(spark, d):
    token = F.when(F.col("l_returnflag") == "A", " True").when(F.col("l_returnflag") == "N", "false.").otherwise("maybe")
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.round(V.p_true(token, F.ln(1.0 - F.col("l_discount"))), 6).alias("p_true"))


@query("judge_retries", "V13", f"""WITH {VERDICTS}, s AS (SELECT *, {ordered_case('lower(raw_text)', V.TERNARY)} AS score FROM v), f AS (SELECT prompt_id, min(judge_id) AS attempt FROM s WHERE score IS NOT NULL GROUP BY 1)
SELECT p.prompt_id, s.score, f.attempt::DOUBLE AS attempt FROM (SELECT DISTINCT prompt_id FROM v) p LEFT JOIN f ON f.prompt_id = p.prompt_id LEFT JOIN s ON s.prompt_id = f.prompt_id AND s.judge_id = f.attempt""")
def judge_retries(spark, d):
    return J.first_readable(B.verdicts(spark, d).withColumnRenamed("judge_id", "attempt"), V.ternary).withColumn("attempt", F.col("attempt").cast("double"))


@query("judge_panel", "D3", f"""WITH {VERDICTS}, s AS (SELECT prompt_id, judge_id, {ordered_case('lower(raw_text)', V.TERNARY)} AS score FROM v)
SELECT prompt_id, {', '.join(f'max(score) FILTER (judge_id = {k}) AS judge_{k + 1}' for k in range(5))}, {', '.join(f'CASE WHEN count(*) = count(score) THEN round({f}(score), 6) END AS {f}' for f in ('avg', 'max', 'min', 'median'))} FROM s GROUP BY 1""")
def judge_panel(spark, d):
    out = J.panel(J.scored(B.verdicts(spark, d)).select("prompt_id", "judge_id", "score"), [0, 1, 2, 3, 4])
    return out.withColumns({c: F.round(c, 6) for c in ("avg", "max", "min", "median")})


@query("judge_prompts", "D1 D4 D6", "SELECT p_partkey AS id, 'Question: ' || p_name || ', Proposed Answer: ' || p_brand || '. ' || " + q(J.instruction("likert", True)) + " AS prompt, p_brand LIKE '%1%' AS grade FROM part")
def judge_prompts(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), J.judge_prompt(F.col("p_name"), F.col("p_brand"), "likert", True).alias("prompt"), F.col("p_brand").contains("1").alias("grade"))
