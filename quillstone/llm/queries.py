"""The corpus operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, remainder, table
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .language_id import identify
from .language_model import score_texts
from .license_scan import scan
from .line_dedup import repeated_runs
from .merkle import FAN_OUT, folded, leaf_of, manifest, proof_digest
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .suffix_dedup import without_repeats
from .token_output import token_files


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and what rows with lower-cased texts give with the proofs."""
    docs = table(spark, sf_dir, "documents")
    altered = leaf_of(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF))
    rows = manifest(docs, LEAF, carry={"altered": F.when(remainder(F.col("doc_id"), 5) == 0, altered)})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.until - s.since)
    return rows.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_decontamination, op3_quality, op4_license_scan, op5_packing,
    op6_language_id, op7_language_model, op8_line_dedup, op9_exact_dedup, op10_token_output,
    op11_merkle_manifest, op12_fill_in_middle, op13_suffix_dedup,
)}

NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(levels: int = 7) -> str:
    """Trees of up to FAN_OUT ** levels nodes, a step for each level; a tree with one node left stays as it is."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in LEAF) + ")"
    # crc32: each character of the id is taken in, then eight steps by one bit
    crc = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    parts = [f"""t0 AS (SELECT *, coalesce('=' || source, '-') AS tree, {leaf("text")} AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, '" + UPPER + "', '" + LOWER + "')")} END AS altered FROM documents)""",
        "a0 AS (SELECT tree, doc_id, leaf, altered, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM t0)"]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}r{k} AS (SELECT tree, pos // {FAN_OUT} AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY 1, 2)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + {FAN_OUT - 1}) // {FAN_OUT} AS n FROM {name}r{k})")

    climb("a")
    parts.append(f"b0 AS (SELECT '' AS tree, tree AS part, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    climb("b")
    parts.append("p0 AS (SELECT a.tree, doc_id, leaf, coalesce(altered, leaf) AS f, '' AS proof, a.pos, b0.pos AS top, b0.h AS subroot FROM a0 a JOIN b0 ON a.tree = b0.part)")
    step = 0
    for name, tree, pos in [("a", "p.tree", "p.pos"), ("b", "''", "p.top")]:
        for k in range(levels):
            own = f"({pos} // {FAN_OUT**k}) % {FAN_OUT}"
            left, right = f"array_to_string(hs[:{own}], '')", f"array_to_string(hs[{own} + 2:], '')"
            left = f"CASE WHEN {own} = 0 THEN '' ELSE {left} END"
            parts.append(f"""p{step + 1} AS (SELECT p.tree, doc_id, leaf, CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f,
                CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, p.pos, p.top, subroot FROM p{step} p JOIN {name}r{k} r ON r.tree = {tree} AND r.run = {pos} // {FAN_OUT ** (k + 1)})""")
            step += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{step}, (SELECT h AS root FROM b{levels})"


_FIM = """WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT *, len(us) AS n, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS hs FROM u),
    c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(us[1:a], '') END AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
_REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM d, LATERAL (SELECT unnest(range(n - 199)) AS i)),
    k AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
    g AS (SELECT r, i, sum(CASE WHEN i <= last + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM k),
    s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, span),
    p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM s),
    j AS (SELECT d.r, any_value(doc_id) AS doc_id, any_value(x) AS x, any_value(n) AS n, max(b) AS stop, sum(b - a) AS gone, count(b) AS spans,
            string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM d LEFT JOIN p ON d.r = p.r GROUP BY d.r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256 FROM j"""
ORACLE_SQL = {
    "op13_suffix_dedup": _REPEATS,
    "op11_merkle_manifest": _merkle_sql(),
    "op12_fill_in_middle": _FIM,
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {NORMALISED} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
