"""Fixed parameters of the registered queries, and shared SQL fragments.

The SQL fragments are the DuckDB twins of the Spark expressions; both sides
use the same literal parameters below.
"""

from __future__ import annotations

# ---- fixed parameters of the registered queries ---------------------------
SEED = 42
RATIOS = (0.7, 0.2, 0.1)
SEQ_LEN = 64            # training row length
WORLD_SIZE = 2          # data-parallel processes
NUM_WORKERS = 2         # loader workers per process
BATCH_SIZE = 8
NGRAM_ALPHA = 0.1       # additive smoothing
MAX_ORDER = 4           # ids that the longest context model looks at, the predicted one included
GENERATION_ORDER = 3    # the same, for generation over contexts
ORDER_PRIOR = 5.0       # weight of the next lower order, in counts
SHOTS = (0, 3)          # solved examples before a multiple-choice item
CONTEXT_BUDGET = 512    # ids of an item's context, the last ones
VOCAB_SIZE = 1000       # ids of the learned tokenizer (specials, bytes and merges)
# ---------------------------------------------------------------------------

# Python str.strip() whitespace, RE2 spelling.
SQL_NONBLANK = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# Java (?U)\s, RE2 spelling (for the word regex).
_W = r"\t\n\x0b\f\r \x{85}\p{Z}"
SQL_WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _W + r"\p{L}\p{N}]+|[" + _W + r"]+")


def sql_pretokenize(col: str) -> str:
    """RE2 has no look-ahead: split a whitespace run before its last char first."""
    return (f"flatten(list_transform(string_split(regexp_replace({col}, '([{_W}]+)([{_W}][^{_W}])', "
            f"'\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: regexp_extract_all(p, '{SQL_WORD_PATTERN.replace(chr(39), chr(39) * 2)}')))")


def sql_uniform(key: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


def _thresholds():
    import math
    t = math.fsum(RATIOS)
    return RATIOS[0] / t, (RATIOS[0] + RATIOS[1]) / t


def sql_split_case(key: str = "doc_id") -> str:
    a, b = _thresholds()
    u = sql_uniform(key)
    return f"CASE WHEN {u} < {a!r} THEN 'train' WHEN {u} < {b!r} THEN 'validation' ELSE 'test' END"


def sql_split_docs() -> str:
    """CTE body: non-blank documents with their split."""
    return (f"SELECT *, {sql_split_case()} AS split FROM documents "
            f"WHERE regexp_matches(text, '{SQL_NONBLANK}')")


def sql_bytes(hex_col: str) -> str:
    """Hex string of UTF-8 bytes -> list of ints."""
    return f"list_transform(regexp_extract_all({hex_col}, '..'), lambda x: ('0x' || x)::INTEGER)"


SQL_CP = ("CASE WHEN (b BETWEEN 33 AND 126) OR (b BETWEEN 161 AND 172) OR b >= 174 THEN b "
          "WHEN b <= 32 THEN b + 256 WHEN b <= 160 THEN b - 127 + 289 ELSE 323 END")


def sql_alphabet() -> str:
    """CTE body: (b, id) for bytes of the training split, ids after the specials."""
    return ("SELECT b, CAST(row_number() OVER (ORDER BY " + SQL_CP + ") + 2 AS INTEGER) AS id FROM ("
            "SELECT DISTINCT unnest(" + sql_bytes("hex(encode(text))") + ") AS b FROM splitdocs WHERE split = 'train')")


def sql_byte_ids(hex_col: str, map_col: str = "m") -> str:
    """Byte-level ids with <bos>; ``map_col`` is the 256-entry id list of `alpha_map`."""
    return (f"list_concat([1::BIGINT], list_transform({sql_bytes(hex_col)}, "
            f"lambda x: CAST({map_col}[x + 1] AS BIGINT)))")


SQL_ALPHA_MAP = ("SELECT list(coalesce(a.id, 2) ORDER BY r.b) AS m, count(a.id) + 3 AS vocab_size FROM "
                 "(SELECT unnest(range(0, 256)) AS b) r LEFT JOIN alpha a ON a.b = r.b")


def sql_token_ctes() -> str:
    """WITH-list: splitdocs, alpha, alpha_map, toks(doc_id, split, ids)."""
    return (f"splitdocs AS ({sql_split_docs()}), alpha AS ({sql_alphabet()}), alpha_map AS ({SQL_ALPHA_MAP}), "
            f"toks AS (SELECT doc_id, split, {sql_byte_ids('hex(encode(text))')} AS ids FROM splitdocs, alpha_map)")
