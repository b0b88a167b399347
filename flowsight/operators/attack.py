"""Attack-technique mapping and knowledge-base operators (C3, C4, H13, H16-H18,
H23, H24, A13, A14, B17, B18, D25, G4).

The attack dimension has one row per known label or alias (fixed, seven rows) and
is always broadcast; knowledge-base tables are ordinary DataFrames and are joined
by key with Spark choosing the strategy.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import urgency

_INFO = ["technique_id", "technique_name", "tactic", "description", "next_techniques", "mitigations"]


def map_attacks(df: DataFrame, dim: DataFrame, label: str = "predicted_attack",
                default_label: str = "Normal") -> DataFrame:
    """Attach technique, tactic, description, next techniques and mitigations;
    labels without a mapping get the `default_label` row (reference behaviour), aliases
    of a mapped label that label's row (is_alias)."""
    d = dim.select(F.col("label").alias("_lab"), *_INFO, "is_alias")
    # the default row is a fixed value of the dimension: literals, no join
    dv = dict(zip(_INFO, dims.ATTACK_MAPPING[default_label]))
    lit = {c: (F.array(*[F.lit(v) for v in dv[c]]).cast("array<string>") if isinstance(dv[c], list)
               else F.lit(dv[c])) for c in _INFO}
    x = df.join(F.broadcast(d), F.col(label) == F.col("_lab"), "left")  # a fixed table of seven rows
    return x.select(*[F.col(c) for c in df.columns], F.coalesce(F.col("is_alias"), F.lit(False)).alias("is_alias"),
                    *[F.coalesce(F.col(c), lit[c]).alias(c) for c in _INFO])


def parse_next_technique(s) -> tuple:
    """`T1078 (Valid Accounts)` -> (T1078, Valid Accounts); no '(' -> (s, s)."""
    tid = F.trim(F.substring_index(s, "(", 1))
    name = F.when(F.instr(s, "(") > 0,
                  F.regexp_replace(F.split(s, "\\(").getItem(1), "\\)+$", "")).otherwise(tid)
    return tid, name


def attack_chain(labels: DataFrame, dim: DataFrame, label: str = "label") -> DataFrame:
    """Current stage (step 0) followed by the parsed possible next stages."""
    m = map_attacks(labels.select(label), dim, label)
    cur = m.select(F.col(label), F.lit(0).alias("step"), F.lit("Current").alias("stage"),
                   "technique_id", "technique_name", "tactic")
    nx = m.select(F.col(label), F.posexplode("next_techniques").alias("pos", "nt"))
    tid, name = parse_next_technique(F.col("nt"))
    nxt = nx.select(F.col(label), (F.col("pos") + 1).alias("step"), F.lit("Possible Next").alias("stage"),
                    tid.alias("technique_id"), name.alias("technique_name"), F.lit("Predicted").alias("tactic"))
    return cur.unionByName(nxt)


def recommendations(df: DataFrame, dim: DataFrame, label: str = "predicted_attack",
                    risk: str = "risk_score") -> DataFrame:
    """Per row, mapping info + urgency + mitigations + chain array."""
    m = map_attacks(df, dim, label)
    chain_head = F.struct(F.lit("Current").alias("stage"), F.col("technique_id"), F.col("technique_name"),
                          F.col("tactic"))
    nxt = F.transform("next_techniques", lambda s: F.struct(
        F.lit("Possible Next").alias("stage"), parse_next_technique(s)[0].alias("technique_id"),
        parse_next_technique(s)[1].alias("technique_name"), F.lit("Predicted").alias("tactic")))
    return m.withColumn("urgency", urgency(F.col(risk))).withColumn(
        "attack_chain", F.concat(F.array(chain_head), nxt))


def mapping_summary(dim: DataFrame) -> DataFrame:
    """First two next stages joined, mitigation count (Normal excluded)."""
    return dim.filter(F.col("label") != "Normal").select(
        "label", "technique_id", "technique_name", "tactic",
        F.array_join(F.slice("next_techniques", 1, 2), ", ").alias("next_stages"),
        F.size("mitigations").alias("n_mitigations"))


def mitigation_priority(dim: DataFrame) -> DataFrame:
    """Position 1-2 Critical, 3-4 Recommended, later Advisory."""
    x = dim.select("label", F.posexplode("mitigations").alias("pos", "mitigation"))
    rank = F.col("pos") + 1
    return x.select("label", rank.alias("rank"), "mitigation",
                    F.when(rank <= 2, "Critical").when(rank <= 4, "Recommended").otherwise("Advisory")
                    .alias("priority"))


# --- knowledge base ---------------------------------------------------------

def load_techniques(spark: SparkSession, path: str, short_len: int = 500) -> DataFrame:
    """Technique table from CSV: trimmed headers, ids starting with T, last
    duplicate wins.  The full description is kept; `description_short` holds
    the display-length version."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return techniques_from(raw.withColumn("_ord", F.monotonically_increasing_id()),
                           "Tactic ID", "Tactic Name", "Description", "Mitigation Steps", "_ord", short_len)


def techniques_from(df: DataFrame, id_col: str, name_col: str, desc_col: str, mit_col: str | None,
                    order_col: str, short_len: int = 500) -> DataFrame:
    x = df.select(F.trim(F.col(f"`{id_col}`").cast("string")).alias("id"),
                  F.trim(F.col(f"`{name_col}`").cast("string")).alias("name"),
                  F.trim(F.col(f"`{desc_col}`").cast("string")).alias("description"),
                  (F.trim(F.col(f"`{mit_col}`").cast("string")) if mit_col else F.lit("")).alias("mitigation"),
                  F.col(order_col).alias("_ord"))
    x = x.filter(F.col("id").startswith("T"))
    last = x.groupBy("id").agg(F.max_by(F.struct("name", "description", "mitigation"), "_ord").alias("r"))
    return last.select("id", "r.name", "r.description", "r.mitigation",
                       F.substring("r.description", 1, short_len).alias("description_short"))


def load_actor_table(spark: SparkSession, path: str) -> DataFrame:
    """A14."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def search_techniques(kb: DataFrame, query: str, n: int | None = 10) -> DataFrame:
    """Case-insensitive substring match in name or description (whole
    text), first n by technique id."""
    ql = query.lower()
    x = kb.filter(F.lower("name").contains(ql) | F.lower("description").contains(ql))
    x = x.orderBy("id")
    return x.limit(n) if n else x


def lookup_technique(ids: DataFrame, kb: DataFrame, id_col: str = "technique_id") -> DataFrame:
    """Technique info with an Unknown default row."""
    k = kb.select(F.col("id").alias("_kid"), "name", "description", "mitigation")
    x = ids.join(k, F.col(id_col) == F.col("_kid"), "left")
    return x.select(*[F.col(c) for c in ids.columns],
                    F.coalesce("name", F.lit("Unknown")).alias("name"),
                    F.coalesce("description", F.lit("Technique not found in knowledge base")).alias("description"),
                    F.coalesce("mitigation", F.lit("No mitigation data available")).alias("mitigation"))


def enrich_kb(mapped: DataFrame, kb: DataFrame) -> DataFrame:
    """C4: knowledge-base description / mitigation where the technique is known
    and the id is not N/A."""
    k = kb.select(F.col("id").alias("_kid"), F.col("description").alias("kb_description"),
                  F.col("mitigation").alias("kb_mitigation"))
    return mapped.join(k, (F.col("technique_id") == F.col("_kid")) & (F.col("technique_id") != "N/A"),
                       "left").drop("_kid")


def actor_groups(actors: DataFrame, group: str = "APT Group Name") -> DataFrame:
    """D25."""
    return actors.select(F.col(f"`{group}`").alias("group_name")).distinct()


def group_techniques(actors: DataFrame, group: str = "APT Group Name",
                     techniques: str = "Group Techniques", only: str | None = None) -> DataFrame:
    """Split ';'-separated techniques, trim, keep ids starting with T,
    distinct per group (all groups, or one with `only`)."""
    x = actors if only is None else actors.filter(F.col(f"`{group}`") == only)
    x = x.select(F.col(f"`{group}`").alias("group_name"),
                 F.explode(F.split(F.col(f"`{techniques}`").cast("string"), ";")).alias("t"))
    x = x.select("group_name", F.trim("t").alias("technique")).filter(F.col("technique").startswith("T"))
    return x.distinct()
