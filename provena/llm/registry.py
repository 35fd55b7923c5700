"""The operators' queries over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import alignment, attribution, chat, decontamination, fingerprints, infill, near_dedup, packing, rules, suffix_dedup, token_files, toxicity, urls

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    shape = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], shape)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.digest(chat.formatted_conversations(rows))
    return read.select(F.col("tree").try_cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


RULES = [
    urls.Rule("com", "/", allow=True),
    urls.Rule("example.com", "/en/", allow=False),
    urls.Rule("www.example.com", "/en/", allow=True),
    urls.Rule("net", "/es/", allow=False),
    urls.Rule("net", "/fr/", allow=False),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(table(spark, sf_dir, "documents"), WORD_BPE)
    return token_files.digest(token_files.read_files(files))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transformed(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), alignment.Pair(BYTE_BPE, PIECE_BPE))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_reply_trees": op2_reply_trees,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_alignment": op12_alignment,
    "op13_quality_rules": op13_quality_rules,
}
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
_PLAIN = "length({0}) + length({0}) - length(regexp_replace({0}, '[\\\\\\[\\]<]', '', 'g'))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The operators whose results SQL can give too. Documents' ids are unique in the driver's tables.
SQL: dict[str, str] = {
    # Lengths of the marks: [SYS] and [/SYS] with their blanks have 13 characters, [INST] 15, [OUT] and </s> 10, [ROLE x] and [/ROLE] 16 and the role.
    "op2_reply_trees": f"""WITH rows AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {_ORDER})) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(t, '' {_ORDER}) FILTER (r = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(CASE r WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 16 + {_PLAIN.format('r')} END + {_PLAIN.format('t')}) AS BIGINT) AS formatted_chars FROM rows GROUP BY conv_id""",
    # All pairs of different sets that share a shingle, then the least node that each can reach.
    "op7_near_dedup": rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
        kinds AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s), items AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM kinds),
        links AS (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT rep AS doc, rep AS low FROM kinds UNION SELECT near.b, reach.low FROM reach JOIN near ON near.a = reach.doc WHERE reach.low < near.b),
        least AS (SELECT doc, min(low) AS low FROM reach GROUP BY doc), found AS (SELECT doc_id, len(sets.s) AS n, coalesce(low, doc_id) AS c FROM sets LEFT JOIN kinds USING (s) LEFT JOIN least ON least.doc = kinds.rep)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM found""",
    # Each passage of 50 words by its text; all but its first place are repeats, and those that touch are one span.
    "op8_suffix_dedup": r"""WITH parts AS (SELECT doc_id, regexp_extract_all(text, '[ 	-
]*[^ 	-
]+') AS p, regexp_extract_all(text, '[^ 	-
]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
        places AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(list_transform(p, lambda x: length(x))) AS size, unnest(list_transform(w, lambda x: length(x))) AS own, w FROM parts WHERE len(w) >= 50),
        ends AS (SELECT doc_id, i, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS e, own, CASE WHEN i + 50 <= len(w) THEN md5(array_to_string(w[i + 1:i + 50], ' ')) END AS k FROM places),
        spots AS (SELECT a.doc_id, a.i, a.e - a.own AS b, z.e, a.k FROM ends a JOIN ends z ON z.doc_id = a.doc_id AND z.i = a.i + 49),
        again AS (SELECT doc_id, i, b, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM spots) WHERE n > 1),
        cut AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM again))
        SELECT doc_id, CAST(min(b) AS BIGINT) AS begin, CAST(max(e) AS BIGINT) AS "end", CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) + 49 AS BIGINT) AS last_word FROM cut GROUP BY doc_id, part""",
    # Units as a list, whose slices are the parts.
    "op11_fill_in_middle": r"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        cut AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS h FROM docs),
        forms AS (SELECT doc_id, t, u, len(u) AS n, h[1] % (len(u) + 1) AS a, h[2] % (len(u) + 1) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
        parts AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM forms)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts""",
    # Windows as rows, counted by their three words; the bits of the eight rules.
    "op13_quality_rules": r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        cut AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
        spots AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM cut WHERE len(w) >= 3),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM spots) WHERE c > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS x(k) GROUP BY r),
        counts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
            length(t) - length(replace(t, '!', '')) AS n_marks, length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters FROM cut LEFT JOIN covered USING (r)),
        bits AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(100 * n_symbols > 10 * n_words AS BIGINT) + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT) + 16 * CAST(100 * n_marks > 20 * n_words AS BIGINT)
            + 32 * CAST(100 * n_upper > 50 * n_letters AS BIGINT) + 64 * CAST(word_chars > 20 * n_words AS BIGINT) + 128 * CAST(word_chars < 2 * n_words AS BIGINT) AS failures FROM counts)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM bits""",
}
