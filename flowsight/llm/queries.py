"""Query registry of the subpackage: opN_<name> over whole tables, next to its
DuckDB SQL where SQL can express it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.llm import (decontaminate, exact_dedup, lexical_search, licenses, lm_score, merkle, mixing, packing,
                           simhash, substring_dedup, token_counts, toxicity, warc)
from flowsight.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def held_out(modulus: int, remainder: int):
    """crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; no SQL: the tokenizer is a library."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@register("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, links at 2 or fewer bits; no SQL: XXH64 is not in it."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


@register("op3_substring_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    s AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN sha256(string_agg(word, ' ') OVER
                 (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM x),
    c AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS dup FROM s),
    g AS (SELECT *, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
          FROM c),
    a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                 string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose crc32 mod 3 is not 1; no SQL: a trained model."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", "predicted",
                         F.size("spans").alias("n_spans"))


@register("op5_warc", r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top FROM p),
    r AS (SELECT *, strlen(h) >= 1000 AND page_id <> top AS again FROM q)
    SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN top END AS refers_to FROM r""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: crc32 mod 10 is 0; no SQL: quantised counts behind hash probes."""
    return lm_score.score(table(spark, sf_dir, "documents"), held_out(10, 0))


@register("op7_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an even crc32 are the snapshot, the others the incoming batch."""
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), held_out(2, 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document; no SQL: banded alignment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every document; no SQL: the canonical form is a program."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op10_mixing", r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
      FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight,
                  3 * source_size AS cap FROM s0),
    s2 AS (SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) AS DOUBLE) AS lft,
                  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS wl FROM s1
           WINDOW b AS (ORDER BY cap / weight, source IS NULL, encode(source)
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT *, cap * wl <= lft * weight AS capped FROM s2),
    s4 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight *
             (SELECT arg_min(lft / wl, cap / weight) FROM s3 WHERE NOT capped) END AS target FROM s3),
    p0 AS (SELECT *, greatest(1, least(4096, CAST(ceil(source_size / 2048) AS BIGINT),
                                       CAST(ceil(target / 2048) AS BIGINT))) AS block
           FROM s4 WHERE source_size > 0),
    p1 AS (SELECT *, (source_size + block - 1) // block AS blocks,
                  CAST(floor(target / block + 0.5) AS BIGINT) AS slots FROM p0),
    p2 AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source IS NULL, encode(source)) AS HUGEINT) AS upto,
                  CAST(sum(slots) OVER () AS HUGEINT) AS total FROM p1),
    p AS (SELECT *, (upto - slots) * 4503599627370496 // total AS lo, upto * 4503599627370496 // total AS hi FROM p2),
    t AS (SELECT r AS slot, list_sum([((r >> i) & 1) * (1::BIGINT << (51 - i)) FOR i IN range(52)])
                 AS point FROM (SELECT unnest(range((SELECT CAST(max(total) AS BIGINT) FROM p))) AS r)),
    sl AS (SELECT p.source, blocks, row_number() OVER (PARTITION BY p.source ORDER BY slot) - 1 AS rnk
           FROM t JOIN p ON point >= lo AND point < hi),
    u AS (SELECT source, rnk % blocks AS block_no, count(*) AS uses FROM sl WHERE rnk < 3 * blocks GROUP BY ALL),
    o AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size) - size AS off FROM d),
    pc AS (SELECT o.doc_id, o.source, o.size, off, block,
                  unnest(range(CAST(off // block AS BIGINT), CAST((off + size - 1) // block + 1 AS BIGINT))) AS block_no
           FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source WHERE size > 0),
    g AS (SELECT doc_id, pc.source, off,
                 sum((least(off + size, (pc.block_no + 1) * block) - greatest(off, pc.block_no * block)) * uses) AS got
          FROM pc JOIN u ON pc.source IS NOT DISTINCT FROM u.source AND pc.block_no = u.block_no GROUP BY ALL)
    SELECT o.doc_id, o.size, s4.source_size, s4.target, CAST(coalesce(got, 0) AS BIGINT) AS taken
    FROM o JOIN s4 ON o.source IS NOT DISTINCT FROM s4.source
    LEFT JOIN g ON g.doc_id = o.doc_id AND g.source IS NOT DISTINCT FROM o.source AND g.off = o.off AND o.size > 0""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_TERM_SQL = r"""list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""


@register("op11_search", rf"""
    WITH x AS (SELECT row_number() OVER () AS r, doc_id, unnest({_TERM_SQL.replace('list_distinct', '')}) AS term FROM documents),
    l AS (SELECT r, count(*) AS n FROM x GROUP BY r),
    z AS (SELECT count(*) AS nd, CAST(sum(n) AS HUGEINT) AS nt FROM l),
    p AS (SELECT r, doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
          FROM p, z GROUP BY term, nd),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERM_SQL}) AS term FROM benchmark)),
    s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) //
                 (1000 * tf + 8 * (10 + CAST((CAST(90 AS HUGEINT) * n * nd) // nt AS BIGINT))))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (r), z GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10""")
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents, ten best each."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@register("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2,048 ids; no SQL: the tokenizer is a library."""
    return packing.pack(table(spark, sf_dir, "documents")).pieces.drop("pid", "row")


@register("op13_merkle", r"""
    WITH RECURSIVE bits(x, k, c) AS (
      SELECT v, 0, v FROM (SELECT unnest(range(256)) AS v)
      UNION ALL SELECT x, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY x) AS t FROM bits WHERE k = 8),
    d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                 coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 3 = 0, false) AS hit
          FROM documents, crc),
    f AS (SELECT doc_id, lang, hit, concat(
            coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
            coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head,
            coalesce(concat(strlen(text), ':', text), '-') AS body, coalesce(concat(strlen(low), ':', low), '-') AS lowered FROM d),
    g AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || body) AS leaf,
                 CASE WHEN hit THEN sha256(head || lowered) ELSE sha256(head || body) END AS changed FROM f),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos,
                      count(*) OVER (PARTITION BY tree) AS n FROM g),
    lv(lvl, tree, pos, h, n) AS (
      SELECT 0, tree, pos, leaf, n FROM leaves
      UNION ALL SELECT lvl + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
      FROM lv WHERE n > 1 GROUP BY lvl, tree, pos // 8, n),
    sub AS (SELECT tree AS grp, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS gpos,
                   count(*) OVER () AS gn FROM lv WHERE n = 1),
    up(lvl, tree, pos, h, n) AS (
      SELECT 0, 'all', gpos, subroot, gn FROM sub
      UNION ALL SELECT lvl + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
      FROM up WHERE n > 1 GROUP BY lvl, tree, pos // 8, n),
    nodes AS (SELECT * FROM lv UNION ALL SELECT * FROM up),
    sib AS (SELECT lvl, tree, pos, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                   coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
            FROM nodes WHERE n > 1 WINDOW r AS (PARTITION BY lvl, tree, pos // 8 ORDER BY pos)),
    fold(lvl, tree, pos, grp, gp, h, proof) AS (
      SELECT 0, tree, pos, tree, pos, changed, '' FROM leaves
      UNION ALL SELECT s.lvl + 1, s.tree, s.pos // 8, grp, gp, sha256(s.lft || f.h || s.rgt), proof || s.lft || s.rgt
      FROM fold f JOIN sib s ON s.lvl = f.lvl AND s.tree = f.tree AND s.pos = f.pos),
    half AS (SELECT grp, gp, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM fold GROUP BY grp, gp),
    fold2(lvl, tree, pos, grp, gp, h, proof) AS (
      SELECT 0, 'all', gpos, grp, gp, h, proof FROM half JOIN sub USING (grp)
      UNION ALL SELECT s.lvl + 1, s.tree, s.pos // 8, grp, gp, sha256(s.lft || f.h || s.rgt), proof || s.lft || s.rgt
      FROM fold2 f JOIN sib s ON s.lvl = f.lvl AND s.tree = f.tree AND s.pos = f.pos),
    done AS (SELECT grp, gp, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM fold2 GROUP BY grp, gp)
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = r.h AS verified
    FROM leaves JOIN done ON done.grp = leaves.tree AND done.gp = leaves.pos JOIN sub ON sub.grp = leaves.tree,
         (SELECT h FROM up WHERE n = 1) AS r""")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree a language; tampering lower-cases the text where crc32 of the id divides by 3."""
    return merkle.manifest(table(spark, sf_dir, "documents"))
