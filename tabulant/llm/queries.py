"""The training-data operators as queries over the given tables, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.llm import ann, bpe, byte_bpe, language, lines, materialise, merkle, mixing, neardup, quality, ranked, topk, urls
from tabulant.storage import new_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", F.col("embedding").alias("vector"))


@query()
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth."""
    vectors = embeddings(spark, sf_dir)
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query()
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, in 256ths."""
    vectors = embeddings(spark, sf_dir).where(topk.usable(F.col("vector")))
    scaled = vectors.select("vec_id", F.transform("vector", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return topk.best_inner_products(scaled, scaled.where("vec_id % 50 = 0"))


def word_tokenizer() -> bpe.Tokenizer:
    """The public lower-case word-end tokenizer that the queries use."""
    import public_tokenizers

    return bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def token_digests(docs: DataFrame, tokenizer: bpe.Tokenizer) -> DataFrame:
    """How many tokens each document has, and hashes of them and of the text they decode to."""
    spark = docs.sparkSession
    both = docs.select("doc_id", bpe.round_trip(spark, tokenizer)(F.coalesce("text", F.lit(""))).alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("both.ids")), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return token_digests(documents(spark, sf_dir), word_tokenizer())


LINES_SQL = r"""
WITH numbered AS (
    SELECT doc_id, coalesce('=' || source, '') AS site, line, line_no
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, line_no)
), bare AS (
    SELECT doc_id, site, line, line_no, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS bare
    FROM numbered
), common AS (
    SELECT bare, min((doc_id, line_no)) AS keep FROM bare WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10
), judged AS (
    SELECT b.doc_id, b.line, b.line_no, c.bare IS NOT NULL AND (b.doc_id, b.line_no) <> c.keep AS gone
    FROM bare b LEFT JOIN common c ON b.bare = c.bare
), cleaned AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN sha256(c.text) END AS text_sha256
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""


@query(LINES_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sources share."""
    cleaned = lines.without_boilerplate(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), filled AS (
    SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
        coalesce(sum(source_size) OVER earlier, 0) AS size_before, coalesce(sum(weight) OVER earlier, 0) AS weight_before
    FROM weighed
    WINDOW earlier AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
    SELECT *, (CAST(1.5 AS DOUBLE) * all_size - 2 * CAST(size_before AS DOUBLE)) / (all_weight - weight_before) AS level FROM filled
), found AS (
    SELECT max(level) AS level FROM levels WHERE 2 * CAST(source_size AS DOUBLE) >= weight * level
), targets AS (
    SELECT source, source_size, CASE WHEN f.level IS NULL THEN 2 * CAST(source_size AS DOUBLE)
        ELSE least(2 * CAST(source_size AS DOUBLE), weight * f.level) END AS target
    FROM weighed, found f
), placed AS (
    SELECT doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs,
        coalesce(sum(size) OVER (
            PARTITION BY t.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
        ), 0) AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM placed
"""


@query(MIX_SQL)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weights takes."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in shuffled shards of two bytes an id, and what these hold when read again."""
    docs, tokenizer = documents(spark, sf_dir), word_tokenizer()
    packed = materialise.packed_texts(spark, tokenizer, tokenizer.special["<|endoftext|>"])(F.coalesce("text", F.lit("")))
    manifest = materialise.materialise(docs.select("doc_id", packed.alias("tokens")), new_path(spark, "shards"))
    return materialise.read_back(spark, manifest)


@query()
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of three quarters of them."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~language.held_out(F.col("doc_id")))
    return quality.score(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


URLS_SQL = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        max_by(r.verdict, length(rule_host || rule_path)) AS verdict
    FROM parts p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
    GROUP BY page_id
)
SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""


@query(URLS_SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by host and path rules."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    found = neardup.near_duplicates(documents(spark, sf_dir), words=3, similarity=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def byte_ranks() -> byte_bpe.Ranks:
    """The public byte-level ranks that the queries use."""
    import public_tokenizers

    return byte_bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def byte_digests(docs: DataFrame, ranks: byte_bpe.Ranks) -> DataFrame:
    """How many byte-level tokens each document has, and hashes of them and of the bytes they decode to."""
    both = docs.select("doc_id", byte_bpe.round_trip(docs.sparkSession, ranks)("text").alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("both.ids")), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


@query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level ranks and decoded again."""
    return byte_digests(documents(spark, sf_dir), byte_ranks())


RANKED_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
    )) AS term FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), whole AS (
    SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), sized AS (
    SELECT doc_id, 100 - 25 + ((25 * n * documents) // terms) AS m FROM lengths, whole
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term
), items AS (
    SELECT item_id, term, count(*) AS c FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
        )) AS term FROM benchmark
    ) GROUP BY item_id, term
), scored AS (
    SELECT item_id, c.doc_id, CAST(sum(i.c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM items i JOIN counts c USING (term) JOIN weights USING (term) JOIN sized s ON s.doc_id = c.doc_id
    GROUP BY item_id, c.doc_id
), placed AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""


@query(RANKED_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that rank highest for each benchmark item."""
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def merkle_sql(source_levels: int = 4, top_levels: int = 3) -> str:
    """The SQL of op11, its levels spelled out: enough for 16^4 documents a source and 16^3 sources."""

    def tree(name: str, leaves: str, levels: int) -> list[str]:
        """Nodes by level; ``n`` counts a tree's nodes on the level, and a lone one is carried up as it is."""
        steps = [f"{name}0 AS ({leaves})"]
        for k in range(levels):
            steps.append(
                f"{name}run{k} AS (SELECT tree, pos // 16 AS pos, n, list(digest ORDER BY pos) AS run FROM {name}{k} GROUP BY tree, pos // 16, n)"
            )
            parent = "CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END"
            steps.append(f"{name}{k + 1} AS (SELECT tree, pos, (n + 15) // 16 AS n, {parent} AS digest FROM {name}run{k})")
        return steps

    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    crc = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, xor(acc, b)),
        4294967295::BIGINT), 4294967295::BIGINT)"""
    parts = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS other FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        *tree("s", "SELECT coalesce('=' || source, '') AS tree, pos, n, leaf AS digest FROM placed", source_levels),
        *tree("t", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, tree AS source FROM s{source_levels}", top_levels),
        "ways AS (SELECT p.*, coalesce('=' || p.source, '') AS tree, t0.pos AS place, t0.digest AS subroot FROM placed p JOIN t0 ON t0.source = coalesce('=' || p.source, ''))",
    ]
    last, fold, siblings = "ways", "other", "''"
    for name, place, key, levels in (("s", "pos", "w.tree", source_levels), ("t", "place", "''", top_levels)):
        for k in range(levels):
            left, right = (
                f"array_to_string(r.run[1:(w.{place} // {16**k}) % 16], '')",
                f"array_to_string(r.run[(w.{place} // {16**k}) % 16 + 2:], '')",
            )
            fold_now = f"CASE WHEN r.n > 1 THEN sha256({left} || {fold} || {right}) ELSE {fold} END AS fold"
            siblings_now = f"{siblings} || CASE WHEN r.n > 1 THEN {left} || {right} ELSE '' END AS siblings"
            keep = "w.* EXCLUDE (fold, siblings)" if fold == "fold" else "w.*"
            parts.append(
                f"way{name}{k} AS (SELECT {keep}, {fold_now}, {siblings_now} FROM {last} w JOIN {name}run{k} r ON r.tree = {key} AND r.pos = w.{place} // {16 ** (k + 1)})"
            )
            last, fold, siblings = f"way{name}{k}", "fold", "siblings"
    root = f"(SELECT digest FROM t{top_levels})"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, {root} AS root, sha256(siblings) AS proof_sha256, fold AS folded_root, fold = {root} AS verified FROM {last}"""


def merkle_digests(docs: DataFrame, shape: merkle.Shape = merkle.Shape()) -> DataFrame:
    """Every document's leaf and roots, a hash of its proof, and the root that its leaf, one in five tampered with, folds to."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = F.when(chosen, F.unhex(merkle.leaf_digest(*fields, lowered)))
    found = merkle.manifest(docs, merkle.leaf_digest(*fields, F.col("text")), [F.col("other")], shape, other=other)
    leaf, given = F.lower(F.hex("digest")), F.lower(F.hex(F.coalesce("other", "digest")))
    root, steps = F.lit(found.root).cast("string"), F.col("steps")
    fold = merkle.folded(given, steps)
    out = found.proofs().select("doc_id", leaf.alias("leaf"), "subroot", root.alias("root"), F.sha2(merkle.siblings(steps), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in the Merkle trees of their sources, checked with every fifth text altered."""
    return merkle_digests(documents(spark, sf_dir))
