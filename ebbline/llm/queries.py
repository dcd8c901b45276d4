"""The operators applied to whole tables with production parameters, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import (
    ann,
    chat,
    decontaminate,
    exact_dedup,
    jaccard,
    language,
    line_dedup,
    mixing,
    prefix_trie,
    quality,
    repair,
    token_files,
    toxicity,
)
from ebbline.llm.skew import join_by_heat
from ebbline.sources.staging import new_path, stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ASIDE = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score_toxicity(_read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    aside = spark.createDataFrame([(-7, 0, "user", ASIDE), (-7, 1, "assistant", ASIDE)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_turns(chat.format_chat(said.unionByName(aside)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, str(public_tokenizers.path(TOKENIZER)), END_ID)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, _read(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def rebuilt(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others do: c takes the first crc32(c) % 9 turns of c - c % 5.

    Takes and returns numbered turns and conversations; the turns returned name their ``n_turns``.
    """
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    wanted = sizes.withColumns({"base": conv - conv % 5, "head": head})
    bases = sizes.select(conv.alias("base"), F.col("n_turns").alias("n_base"))
    wanted = wanted.join(bases, "base", "left")
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    wanted = wanted.withColumn("taken", taken).select(
        "conv_id", "base", "head", "taken", "n_turns", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))).alias("whole")
    )
    wanted = stage(wanted, "rebuilt")
    own = join_by_heat(turns, wanted.select("conv_id", "head", "taken", "whole", "n_turns"), ["conv_id"], "n_turns")
    own = own.where("place >= head").withColumn("place", F.col("place") - F.col("head") + F.col("taken"))
    # At most eight turns of a conversation are taken, by at most nine others.
    heads = turns.where("conv_id % 5 = 0 and place < 8").withColumnRenamed("conv_id", "base")
    copied = heads.join(wanted.where("taken > 0").select("conv_id", "base", "taken", "whole"), "base").where("place < taken")
    columns = ["conv_id", F.col("whole").alias("n_turns"), "place", "x", "y", "n_bytes"]
    whole = own.select(columns).unionByName(copied.select(columns))
    return whole, wanted.select("conv_id", F.col("whole").alias("n_turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(*rebuilt(*prefix_trie.number_turns(_read(spark, sf_dir, "conversations"))))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    how = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), how.alias("how")).where("how <> 0")
    shown = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), shown.alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


def op13_repair_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "conversations")
    found = repair.summarise(repair.repair_conversations(damaged(said)))
    whole = said.select(F.col("conv_id").alias("conv")).distinct()
    both = whole.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}
    return both.select(
        F.col("conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *repair.FAULTS, "illegal", "cost")],
        *[F.coalesce(c, empty).alias(c) for c, empty in nothing.items()],
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_nearest_neighbours,
        op3_jaccard_join,
        op4_toxicity,
        op5_chat_format,
        op6_language_id,
        op7_decontaminate,
        op8_mix_sources,
        op9_line_dedup,
        op10_token_files,
        op11_exact_dedup,
        op12_prefix_trie,
        op13_repair_structure,
    )
}

_CONTROL = r"(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>|<</TURN>>)"

# A table of the 256 remainders of the CRC-32 (polynomial 0xEDB88320), and the sum over a text's
# ASCII characters.
_CRC = """
crc_steps AS (
  SELECT i AS n, i AS v, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS (
  SELECT list(v ORDER BY n) AS crc FROM crc_steps WHERE step = 8
)
"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "xor(s >> 8, crc[CAST(xor(s, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce({codes}, lambda s, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


ORACLES = {
    "op5_chat_format": rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ASIDE}'
  UNION ALL SELECT -7, 1, 'assistant', '{ASIDE}'
), sized AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
    length(regexp_replace(replace(text, '\', '\\'), '{_CONTROL}', '\1\\', 'g')) AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), walked AS (
  SELECT *, CASE WHEN place = 1 THEN role NOT IN ('system', 'user')
    WHEN before = 'assistant' OR before = 'system' THEN role <> 'user'
    ELSE role <> 'assistant' END AS wrong
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
    ELSE 26 + length(regexp_replace(replace(role, '\', '\\'), '{_CONTROL}', '\1\\', 'g')) END) AS BIGINT) AS formatted_chars,
  CASE WHEN bool_or(wrong) THEN min_by('turn ' || turn || ': ' || role, CASE WHEN wrong THEN place ELSE 1000000000 END)
    WHEN max(role) FILTER (back = 1) = 'system' THEN 'ends briefed' END AS fault
FROM walked GROUP BY conv_id
""",
    "op8_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS place FROM totals
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100
      - coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights
  FROM ranked
), first_free AS (
  SELECT place, rest, weights FROM levels WHERE 2 * source_size > weight * (rest / weights) ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN r.place < coalesce((SELECT place FROM first_free), 1e18) THEN CAST(2 * source_size AS DOUBLE)
      ELSE (SELECT rest FROM first_free) * weight / (SELECT weights FROM first_free) END AS target
  FROM ranked r
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':8')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""",
    "op9_line_dedup": r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM keyed k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op11_exact_dedup": r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), placed AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM digests WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM placed
""",
    "op12_prefix_trie": f"""
WITH RECURSIVE {_CRC}, plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), said AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM plain
), sizes AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS head
  FROM (SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id), crc_table
), wanted AS (
  SELECT s.*, least(s.head, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base
), whole AS (
  SELECT w.conv_id, s.place - w.head + w.taken AS place, role, text FROM wanted w JOIN said s USING (conv_id) WHERE s.place >= w.head
  UNION ALL
  SELECT w.conv_id, s.place, role, text FROM wanted w JOIN said s ON s.conv_id = w.base WHERE s.place < w.taken
), members AS (
  SELECT conv_id, place + 1 AS depth, octet_length(encode(text)) AS n_bytes,
    md5(string_agg(md5(role) || md5(text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place)) AS node
  FROM whole
  UNION ALL SELECT conv_id, 0, 0, '' FROM sizes
), ended AS (
  SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id
), nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e.depth IS NOT NULL), '')) AS ends_sha256
  FROM members m LEFT JOIN ended e USING (conv_id, depth) GROUP BY node
), linked AS (
  SELECT DISTINCT m.node, u.node AS up FROM members m JOIN members u ON u.conv_id = m.conv_id AND u.depth = m.depth - 1
), children AS (
  SELECT up AS node, count(*) AS n_children FROM linked GROUP BY up
), subtrees AS (
  SELECT DISTINCT t.node, b.node AS below FROM members t JOIN members b ON b.conv_id = t.conv_id AND b.depth >= t.depth
), summed AS (
  SELECT s.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n_bytes) AS BIGINT) AS saved_tokens
  FROM subtrees s JOIN nodes b ON b.node = s.below LEFT JOIN children c ON c.node = s.below GROUP BY s.node
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s USING (node) LEFT JOIN children c USING (node)
  LEFT JOIN linked l ON l.node = n.node LEFT JOIN nodes u ON u.node = l.up
""",
    "op13_repair_structure": f"""
WITH RECURSIVE {_CRC}, plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), drawn AS (
  SELECT *, {_crc("key")} % 20 AS how FROM plain, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(2) r(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(lag(role) OVER w, 1) || left(role, 1) AS pair
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), states(state, initial, next) AS (
  VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), inserts(state, next, edits) AS (
  VALUES ('', '', ''), ('', 'u', 'I'), ('', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'),
    ('u', 'u', ''), ('u', 'a', 'I'), ('u', 'u', 'II'), ('a', 'a', ''), ('a', 'u', 'I'), ('a', 'a', 'II')
), moves AS (
  SELECT i.state, i.edits AS before, s.initial, s.next, e.edit, 2 * length(i.edits) + e.cost AS cost
  FROM inserts i JOIN states s ON s.state = i.next CROSS JOIN (VALUES ('K', 0), ('R', 2)) e(edit, cost)
  WHERE e.edit = 'K' OR s.initial <> 's'
  UNION ALL SELECT state, edits, NULL, next, 'D', 2 * length(edits) + 3 FROM inserts
), made AS (
  SELECT m.*, list_transform(string_split(before, ''), lambda x, i: CASE WHEN (state = 'u') = (i % 2 = 1) THEN 'assistant:' ELSE 'user:' END) AS lines
  FROM moves m
), walked AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, place, state, b.c, b.a, b.l FROM (
    SELECT w.conv_id, f.place, m.next AS state, min(struct_pack(
      c := CAST(w.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END AS BIGINT),
      a := w.audit || m.before || m.edit,
      l := w.lines || CASE WHEN m.before = '' THEN [] ELSE m.lines END || CASE m.edit WHEN 'K' THEN [f.role || ':' || f.text]
        WHEN 'R' THEN [CASE m.next WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [] END)) AS b
    FROM walked w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
      JOIN made m ON m.state = w.state
    WHERE (m.edit = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (m.edit <> 'K' OR m.initial = left(f.role, 1))
    GROUP BY ALL
  )
), longest AS (
  SELECT conv_id, max(place) AS place FROM walked GROUP BY conv_id
), finished AS (
  SELECT w.conv_id, min(struct_pack(c := w.cost + 2 * length(i.edits), a := w.audit || i.edits, l := w.lines ||
      CASE i.edits WHEN '' THEN [] WHEN 'I' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END)) AS b
  FROM walked w JOIN longest l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.place = w.place
    JOIN inserts i ON i.state = w.state AND (i.next = 'a' OR (i.next = '' AND i.state = ''))
  GROUP BY w.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit,
  sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM finished f LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM f.conv_id
""",
}
