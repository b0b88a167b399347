"""Attack mapping and knowledge-base queries (C3, C4, H16, H18, H23, H24, B17,
B18, D25, G4/H17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import r6
from flowsight.operators import attack as A
from flowsight.plans.behavior_q import _MERGED, _V, merged
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import urgency_sql, with_flows
from flowsight.sources.tables import actors_from_documents, flows, kb_from_documents, table


def _lst(v):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]::VARCHAR[]"


_DIM_ROWS = ", ".join(
    f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}', '{v[3].replace(chr(39), chr(39) * 2)}', {_lst(v[4])}, {_lst(v[5])}, {v[6]})"
    for k, *v in dims.attack_rows())
DIM = (f"dim AS (SELECT * FROM (VALUES {_DIM_ROWS}) t(label, technique_id, technique_name, tactic, "
       "description, next_techniques, mitigations, is_alias))")
_N = dims.ATTACK_MAPPING["Normal"]
_MAPPED = f"""mapped AS (SELECT f.id, f.predicted_attack,
  coalesce(d.technique_id, '{_N[0]}') AS technique_id, coalesce(d.technique_name, '{_N[1]}') AS technique_name,
  coalesce(d.tactic, '{_N[2]}') AS tactic, coalesce(d.mitigations, {_lst(_N[5])}) AS mitigations,
  coalesce(d.next_techniques, {_lst(_N[4])}) AS next_techniques, coalesce(d.is_alias, false) AS is_alias, f.risk_score
  FROM final f LEFT JOIN dim d ON f.predicted_attack = d.label)"""


@register("map_attacks", with_flows(_V, _MERGED, DIM, _MAPPED) + """SELECT id, predicted_attack, technique_id,
  technique_name, tactic, is_alias, CAST(len(mitigations) AS INTEGER) AS n_mitigations FROM mapped""")
def q_map_attacks(spark, sf):
    m = A.map_attacks(merged(spark, sf).select("id", "predicted_attack"), dims.attack_dim(spark))
    return m.select("id", "predicted_attack", "technique_id", "technique_name", "tactic", "is_alias",
                    F.size("mitigations").alias("n_mitigations"))


@register("attack_chain", with_flows(_V, _MERGED, DIM) + """, labs AS (SELECT DISTINCT predicted_attack AS label FROM final),
m2 AS (SELECT l.label, coalesce(d.technique_id, 'N/A') AS technique_id,
  coalesce(d.technique_name, 'Benign Traffic') AS technique_name, coalesce(d.tactic, 'N/A') AS tactic,
  coalesce(d.next_techniques, []::VARCHAR[]) AS nt FROM labs l LEFT JOIN dim d USING (label)),
ex AS (SELECT label, CAST(i AS INTEGER) AS step, nt[i] AS s FROM m2, range(1, len(nt) + 1) r(i))
SELECT label, 0 AS step, 'Current' AS stage, technique_id, technique_name, tactic FROM m2
UNION ALL
SELECT label, step, 'Possible Next', trim(split_part(s, '(', 1)),
  CASE WHEN strpos(s, '(') > 0 THEN rtrim(split_part(s, '(', 2), ')') ELSE trim(split_part(s, '(', 1)) END,
  'Predicted' FROM ex""")
def q_attack_chain(spark, sf):
    labs = merged(spark, sf).select(F.col("predicted_attack").alias("label")).distinct()
    return A.attack_chain(labs, dims.attack_dim(spark)).select(
        "label", "step", "stage", "technique_id", "technique_name", "tactic")


@register("recommendations", with_flows(_V, _MERGED, DIM, _MAPPED) + f"""SELECT id, technique_id,
  {urgency_sql('risk_score')} AS urgency, CAST(len(mitigations) AS INTEGER) AS n_mitigations,
  CAST(len(next_techniques) + 1 AS INTEGER) AS chain_len, round(risk_score, 6) AS risk_score FROM mapped""")
def q_recommendations(spark, sf):
    r = A.recommendations(merged(spark, sf).select("id", "predicted_attack", "risk_score"), dims.attack_dim(spark))
    return r.select("id", "technique_id", "urgency", F.size("mitigations").alias("n_mitigations"),
                    F.size("attack_chain").alias("chain_len"), r6(F.col("risk_score")).alias("risk_score"))


_SEEN = "seen AS (SELECT DISTINCT predicted_attack AS label FROM flows WHERE predicted_attack <> 'Normal')"


@register("mapping_summary", with_flows(DIM, _SEEN) + """SELECT d.label, technique_id, technique_name, tactic,
  array_to_string(next_techniques[1:2], ', ') AS next_stages, CAST(len(mitigations) AS INTEGER) AS n_mitigations
  FROM dim d JOIN seen USING (label)""")
def q_mapping_summary(spark, sf):
    seen = flows(spark, sf).filter(F.col("predicted_attack") != "Normal").select(
        F.col("predicted_attack").alias("label")).distinct()
    return A.mapping_summary(dims.attack_dim(spark)).join(F.broadcast(seen), "label")


@register("mitigation_priority", with_flows(DIM, _SEEN) + """SELECT label, CAST(i AS INTEGER) AS rank,
  mitigations[i] AS mitigation,
  CASE WHEN i <= 2 THEN 'Critical' WHEN i <= 4 THEN 'Recommended' ELSE 'Advisory' END AS priority
  FROM dim JOIN seen USING (label), range(1, len(mitigations) + 1) r(i)""")
def q_mitigation_priority(spark, sf):
    seen = flows(spark, sf).filter(F.col("predicted_attack") != "Normal").select(
        F.col("predicted_attack").alias("label")).distinct()
    return A.mitigation_priority(dims.attack_dim(spark)).join(F.broadcast(seen), "label")


_KB = """kb AS (SELECT 'T' || CAST(1000 + doc_id AS VARCHAR) AS id, concat_ws(' ', source, lang) AS name,
  trim(text) AS description, 'Review source ' || source AS mitigation FROM documents)"""
_Q = "ering"
_QS = (_Q, "qu", "Z", "Spark ", "no such words")


@register("search_techniques", f"WITH {_KB} SELECT id, name FROM kb WHERE contains(lower(name), '{_Q}') "
          f"OR contains(lower(description), '{_Q}') ORDER BY id LIMIT 10")
def q_search(spark, sf):
    kb = kb_from_documents(table(spark, sf, "documents"))
    return A.search_techniques(kb, _Q, 10).select("id", "name")


@register("search_index", f"""WITH {_KB}, q AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _QS)}) t(query))
  SELECT query, id FROM q JOIN kb ON contains(lower(name), lower(query)) OR contains(lower(description), lower(query))""")
def q_search_index(spark, sf):
    """B17 through trigram postings: every row for several searches, short ones too."""
    import uuid

    from flowsight.operators import trigrams
    from flowsight.session import ensure_checkpoint_dir, join_path
    path = join_path(ensure_checkpoint_dir(spark), "trigrams-" + uuid.uuid4().hex)
    trigrams.build_index(kb_from_documents(table(spark, sf, "documents")), path)
    qs = spark.createDataFrame([(x, x) for x in _QS], "key string, query string")
    return trigrams.search_many(qs, path).withColumnRenamed("key", "query")


_IDS = [v[0] for v in dims.ATTACK_MAPPING.values()]


@register("lookup_technique", f"WITH {_KB}, ids AS (SELECT * FROM (VALUES {', '.join(f'({i!r})' for i in _IDS)}) "
          "t(technique_id)) SELECT technique_id, coalesce(name, 'Unknown') AS name, "
          "coalesce(mitigation, 'No mitigation data available') AS mitigation, "
          "length(coalesce(description, 'Technique not found in knowledge base')) AS description_len "
          "FROM ids LEFT JOIN kb ON technique_id = id")
def q_lookup(spark, sf):
    kb = kb_from_documents(table(spark, sf, "documents"))
    ids = spark.createDataFrame([(i,) for i in _IDS], "technique_id string")
    x = A.lookup_technique(ids, kb)
    return x.select("technique_id", "name", "mitigation", F.length("description").cast("long").alias("description_len"))


@register("enrich_kb", f"WITH {_KB}, {DIM} SELECT label, technique_id, kb.name AS kb_name, "
          "length(kb.description) AS kb_description_len FROM dim LEFT JOIN kb "
          "ON technique_id = kb.id AND technique_id <> 'N/A'")
def q_enrich(spark, sf):
    kb = kb_from_documents(table(spark, sf, "documents"))
    m = A.map_attacks(dims.attack_dim(spark).select("label"), dims.attack_dim(spark), "label")
    x = A.enrich_kb(m, kb.select("id", "name", "description", "mitigation"))
    names = kb.select(F.col("id").alias("_i"), F.col("name").alias("kb_name"))
    x = x.join(names, (F.col("technique_id") == F.col("_i")) & (F.col("technique_id") != "N/A"), "left")
    return x.select("label", "technique_id", "kb_name",
                    F.length("kb_description").cast("long").alias("kb_description_len"))


_ACT = """act AS (SELECT source AS g, 'T' || CAST(1000 + doc_id AS VARCHAR) || '; ' || lang || ';T'
  || CAST(n_chars AS VARCHAR) || ' ' AS t FROM documents)"""


@register("actor_groups", f"WITH {_ACT} SELECT DISTINCT g AS group_name FROM act")
def q_actor_groups(spark, sf):
    return A.actor_groups(actors_from_documents(table(spark, sf, "documents")))


@register("group_techniques", f"WITH {_ACT} SELECT DISTINCT g AS group_name, trim(x) AS technique "
          "FROM act, unnest(string_split(t, ';')) u(x) WHERE starts_with(trim(x), 'T')")
def q_group_techniques(spark, sf):
    return A.group_techniques(actors_from_documents(table(spark, sf, "documents")))


def _scratch_csv(spark, df, tag):
    import uuid

    from flowsight.session import ensure_checkpoint_dir, join_path
    path = join_path(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@register("load_techniques", f"""WITH {_KB}, k2 AS (SELECT id, arg_max(name, description) AS name, max(description) AS description
  FROM kb GROUP BY id) SELECT id, name, length(description) AS description_len,
  length(substr(description, 1, 500)) AS short_len FROM k2""")
def q_load_techniques(spark, sf):
    """Technique CSV (untidy headers, quoted line breaks) written and loaded."""
    kb = kb_from_documents(table(spark, sf, "documents"))
    path = _scratch_csv(spark, kb.select(
        F.col("id").alias(" Tactic ID "), F.col("name").alias("Tactic Name"), F.col("description").alias("Description "),
        F.col("mitigation").alias("Mitigation Steps")), "techniques")
    x = A.load_techniques(spark, path)
    return x.select("id", "name", F.length("description").cast("long").alias("description_len"),
                    F.length("description_short").cast("long").alias("short_len"))


@register("load_actor_table", f"""WITH {_ACT} SELECT g AS group_name, t AS techniques FROM act""")
def q_load_actor_table(spark, sf):
    """Actor CSV written and loaded; headers trimmed."""
    act = actors_from_documents(table(spark, sf, "documents"))
    path = _scratch_csv(spark, act.select(*[F.col(f"`{c}`").alias(f" {c} ") for c in act.columns]), "actors")
    x = A.load_actor_table(spark, path)
    return x.select(F.col("`APT Group Name`").alias("group_name"), F.col("`Group Techniques`").alias("techniques"))
