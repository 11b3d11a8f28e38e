"""Pieces of DuckDB SQL that the checks share: the canonical inputs, and the stand-in for an entailment model."""

from __future__ import annotations

R1 = """r1 AS (SELECT prompt_id, sample_idx, text FROM (
  SELECT l_orderkey AS prompt_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS sample_idx,
    l_returnflag || l_linestatus AS text, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c = 6)"""

T1 = """t0 AS (SELECT * FROM (
  SELECT l_orderkey AS prompt_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS sample_idx,
    l_discount, l_tax, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c = 6
), t1 AS (SELECT prompt_id, sample_idx, k AS token_idx, ln(p) AS logprob, [ln(p), ln(l_discount / 4.0::DOUBLE + 0.01::DOUBLE), ln(l_tax / 4.0::DOUBLE + 0.02::DOUBLE)] AS top
  FROM (SELECT *, unnest([0, 1, 2]) AS k, unnest([1 - l_discount, 1 - l_tax, l_quantity / 51.0::DOUBLE]) AS p FROM t0))"""

E1 = """e1 AS (SELECT label::BIGINT AS prompt_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx, embedding::DOUBLE[] AS vec FROM embeddings)"""

R2 = """r2 AS (SELECT prompt_id, sample_idx, text FROM (
  SELECT conv_id AS prompt_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS sample_idx, text, count(*) OVER (PARTITION BY conv_id) AS c
  FROM conversations WHERE role = 'assistant') WHERE c >= 2)"""

G1 = """g1 AS (SELECT l.doc_id AS prompt_id, l.quality AS correct, (n_chars % 97) / 96.0::DOUBLE AS s1, (n_chars % 53) / 52.0::DOUBLE AS s2, (l.doc_id % 31) / 30.0::DOUBLE AS s3,
  CASE WHEN l.doc_id % 5 <> 0 THEN (n_chars % 11) / 10.0::DOUBLE END AS s4 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

GL = G1 + """, gl AS (SELECT prompt_id, correct, scorer, score FROM (
  SELECT prompt_id, correct, 's1' AS scorer, s1 AS score FROM g1 UNION ALL SELECT prompt_id, correct, 's2', s2 FROM g1
  UNION ALL SELECT prompt_id, correct, 's3', s3 FROM g1 UNION ALL SELECT prompt_id, correct, 's4', s4 FROM g1) WHERE score IS NOT NULL)"""


def chars(t: str) -> str:
    return f"list_distinct(string_split({t}, ''))"


def words(t: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-z]+'), lambda z: z <> ''))"


def entail(a: str, b: str, split=chars) -> str:
    """Probability that a entails b."""
    return f"sqrt(coalesce(len(list_intersect({split(a)}, {split(b)}))::DOUBLE / nullif(len({split(b)}), 0), 0.0::DOUBLE))"


def nli(a: str, b: str, tag: str, split=chars) -> str:
    """Columns entail_, contra_, neutral_, top_ of a pair; equal texts entail each other."""
    e = entail(a, b, split)
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {e} END AS entail_{tag}, CASE WHEN {a} = {b} THEN 0.0::DOUBLE ELSE (1 - {e}) * 0.6::DOUBLE END AS contra_{tag},
      CASE WHEN {a} = {b} THEN 0.0::DOUBLE ELSE (1 - {e}) * 0.4::DOUBLE END AS neutral_{tag}, ({a} = {b} OR {e} > (1 - {e}) * 0.6::DOUBLE) AS top_{tag}"""


#: Clusters of R1 by the greedy rule: leaders by a recursive fold, members by the leaders' equivalences.
CLUSTERS = f"""{R1}, pr AS (
  SELECT x.prompt_id, x.sample_idx AS i, y.sample_idx AS j, {nli('x.text', 'y.text', 'ab')}, {nli('y.text', 'x.text', 'ba')}
  FROM r1 x JOIN r1 y ON x.prompt_id = y.prompt_id AND x.sample_idx < y.sample_idx
), ed AS (SELECT prompt_id, i, j FROM pr WHERE top_ab OR top_ba
), el AS (SELECT p.prompt_id, coalesce(list(i * 1000 + j) FILTER (i IS NOT NULL), []::INT[]) AS e FROM (SELECT DISTINCT prompt_id FROM r1) p LEFT JOIN ed USING (prompt_id) GROUP BY 1
), fold AS (
  SELECT prompt_id, 0 AS nr, [0] AS leaders FROM el
  UNION ALL
  SELECT f.prompt_id, f.nr + 1, CASE WHEN len(list_filter(f.leaders, lambda z: list_contains(el.e, z * 1000 + f.nr + 1))) > 0 THEN f.leaders ELSE list_append(f.leaders, f.nr + 1) END
  FROM fold f JOIN el USING (prompt_id) WHERE f.nr < 5
), ld AS (SELECT prompt_id, unnest(leaders) AS leader, generate_subscripts(leaders, 1) - 1 AS cluster_idx FROM fold WHERE nr = 5
), mb AS (
  SELECT l.prompt_id, l.cluster_idx::INT AS cluster_idx, r.sample_idx AS resp_idx FROM ld l JOIN r1 r ON r.prompt_id = l.prompt_id
  JOIN el ON el.prompt_id = l.prompt_id WHERE r.sample_idx = l.leader OR (r.sample_idx > l.leader AND list_contains(el.e, l.leader * 1000 + r.sample_idx)))"""
