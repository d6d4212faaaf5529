"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

DuckDB lists are 1-based; lambdas use the ``lambda x: ...`` form. The cross
products below exist only in the oracle: they are the brute-force definition
that the Spark operators must reproduce without materialising pairs.
"""

from __future__ import annotations

DIM = 64
WORDS = DIM // 32

SQL: dict[str, str] = {}


def _bit(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0 ELSE 1 END)"


def pack(v: str) -> str:
    """Sign code: 32-bit words, MSB first."""
    return (f"list_transform(range(0, (len({v}) + 31) // 32), lambda w: "
            f"list_reduce(list_transform({v}[w * 32 + 1 : w * 32 + 32], lambda x: {_bit('x')}::BIGINT), "
            f"lambda a, b: a * 2 + b, 0::BIGINT))")


def ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def ip_sign(a: str, b: str) -> str:
    """float a . (+1/-1 signs of b)."""
    return (f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * "
            f"(CASE WHEN {b}[i] < 0 THEN -1.0 ELSE 1.0 END)))")


def ham(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: bit_count(xor({a}[i], {b}[i]))::BIGINT))::BIGINT"


V = "SELECT vec_id AS id, embedding, label FROM embeddings"

SQL["h6_binarize"] = f"""
SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: {_bit('x')}), '') AS bits
FROM embeddings"""

SQL["h7_pack_bits"] = f"""
SELECT vec_id AS id, array_to_string({pack('embedding')}, ',') AS code FROM embeddings"""

SQL["h8_unpack_signs"] = f"""
SELECT id, array_to_string(list_transform(range(0, {DIM}), lambda i:
         CASE WHEN ((code[i // 32 + 1] >> (31 - i % 32)) & 1) = 1 THEN '+' ELSE '-' END), '') AS signs
FROM (SELECT vec_id AS id, {pack('embedding')} AS code FROM embeddings)"""

SQL["h9_inner_product"] = f"""
SELECT vec_id AS id, round({ip('embedding', 'embedding')}, 6) AS sq_norm,
       round({ip_sign('embedding', 'embedding')}, 6) AS l1_norm
FROM embeddings"""

SQL["h10_hamming"] = f"""
WITH c AS (SELECT vec_id AS id, {pack('embedding')} AS code FROM embeddings)
SELECT a.id, {ham('a.code', 'b.code')} AS distance FROM c a JOIN c b ON b.id = a.id + 1"""

SQL["c2_dense_knn"] = f"""
WITH v AS ({V}),
pairs AS (SELECT q.id AS qid, p.id AS id, {ip('q.embedding', 'p.embedding')} AS score FROM v q, v p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs)
SELECT qid, id, round(score, 6) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 10"""

SQL["c3_hamming_knn"] = f"""
WITH c AS (SELECT vec_id AS id, {pack('embedding')} AS code FROM embeddings),
pairs AS (SELECT q.id AS qid, p.id AS id, {ham('q.code', 'p.code')} AS distance FROM c q, c p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM pairs)
SELECT qid, id, distance::BIGINT AS distance, rank::BIGINT AS rank FROM r WHERE rank <= 10"""


def binary_hits(k: int, binary_k: int) -> str:
    """CTE chain ending in `hits(qid, id, distance, score, rank)`."""
    return f"""
c AS (SELECT vec_id AS id, embedding, label, {pack('embedding')} AS code FROM embeddings),
pairs AS (SELECT q.id AS qid, p.id AS id, {ham('q.code', 'p.code')} AS distance,
                 {ip_sign('q.embedding', 'p.embedding')} AS score FROM c q, c p),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS crn
                        FROM pairs) WHERE crn <= {binary_k}),
hits AS (SELECT * FROM (SELECT qid, id, distance, score,
                 row_number() OVER (PARTITION BY qid ORDER BY score DESC, distance, id) AS rank
                 FROM cand) WHERE rank <= {k})"""


SQL["c4_binary_rerank"] = f"""
WITH {binary_hits(10, 64)}
SELECT qid, id, distance::BIGINT AS distance, round(score, 6) AS score, rank::BIGINT AS rank FROM hits"""

_RANKS = f"""
WITH {binary_hits(100, 128)},
flag AS (SELECT h.qid, h.rank, (p.label = q.label AND h.id <> h.qid) AS is_positive
         FROM hits h JOIN c p ON p.id = h.id JOIN c q ON q.id = h.qid),
ranks AS (SELECT c.id AS qid, min(f.rank) FILTER (WHERE f.is_positive)::BIGINT AS positive_rank
          FROM c LEFT JOIN flag f ON f.qid = c.id GROUP BY c.id)"""

SQL["d2_first_positive_rank"] = _RANKS + "\nSELECT qid, positive_rank FROM ranks"

SQL["d1_recall_at_k"] = _RANKS + """
SELECT k::BIGINT AS k, sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END)::BIGINT AS n_correct,
       count(*)::BIGINT AS n_questions,
       round(sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall
FROM ranks, (SELECT unnest([1, 2, 5, 10, 20, 50, 100]) AS k) ks GROUP BY k"""

SQL["c1_hits_with_passages"] = f"""
WITH {binary_hits(5, 64)}
SELECT h.qid, h.rank::BIGINT AS rank, h.id, split_part(d.text, chr(10), 1) AS title, d.source AS dataset,
       length(d.text)::BIGINT AS text_chars
FROM hits h JOIN documents d ON d.doc_id = h.id"""


# ---------------------------------------------------------------- text
import unicodedata  # noqa: E402

TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
BLANKS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
TEXT_DIM = 64


def _nfd_table():
    """Canonical decompositions of the Latin-1 and Latin Extended-A letters, by rule."""
    out = []
    for cp in range(0xC0, 0x180):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if d != ch:
            out.append((ch, d))
    return out


_NFD = _nfd_table()


def nfd(x: str) -> str:
    """NFD emulation, exact for text whose non-ASCII letters are Latin-1/Extended-A."""
    for ch, d in _NFD:
        x = f"replace({x}, '{ch}', '{d}')"
    return x


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t))"


def collapse(x: str, sep: str = " ") -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANKS}|{BLANKS}$', '', 'g'), '{BLANKS}', '{sep}', 'g')"


def joined(toks: str) -> str:
    return f"(chr(1) || array_to_string({toks}, chr(1)) || chr(1))"


def dpr_string(a: str, p: str) -> str:
    at = tokens(nfd(a))
    return f"(CASE WHEN len({at}) = 0 THEN true ELSE contains({joined(tokens(nfd(p)))}, {joined(at)}) END)"


def bucket(t: str) -> str:
    return f"((('0x' || substr(md5({t}), 1, 8))::BIGINT % {TEXT_DIM}) + 1)"


def sign(t: str) -> str:
    return f"(CASE WHEN ('0x' || substr(md5({t}), 9, 1))::INT % 2 = 1 THEN -1 ELSE 1 END)"


def encoded(src: str, key: str, text: str) -> str:
    """Hash encoder: `src` is a relation with columns `key` and `text`; yields (key, embedding)."""
    return f"""(SELECT s.{key}, list(coalesce(hb.val, 0)::DOUBLE ORDER BY r.b) AS embedding
   FROM {src} s CROSS JOIN (SELECT unnest(range(1, {TEXT_DIM + 1})) AS b) r
   LEFT JOIN (SELECT {key}, {bucket('t')} AS b, sum({sign('t')}) AS val
              FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {src}) GROUP BY ALL) hb
     ON hb.{key} = s.{key} AND hb.b = r.b
   GROUP BY s.{key})"""


QUESTIONS = """(SELECT item_id AS qid, text AS question,
   list_filter([regexp_extract_all(text, '\\S+')[1],
                array_to_string(regexp_extract_all(text, '\\S+')[3:6], ' ')], lambda a: length(a) > 0) AS answers
   FROM benchmark)"""
PASSAGES = "(SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text, source AS dataset FROM documents)"


def ham_vec(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
            f"CASE WHEN ({a}[i] < 0) = ({b}[i] < 0) THEN 0 ELSE 1 END))::BIGINT")


def text_hits(k: int, binary_k: int, questions: str = QUESTIONS) -> str:
    """CTE chain: qs, ps, qv, pv, tpairs, thits(qid, id, distance, score, rank, title, text, answers)."""
    return f"""
qs AS {questions},
ps AS {PASSAGES},
qv AS {encoded("(SELECT qid, rtrim(question, '?') AS qtext FROM qs)", "qid", "qtext")},
pv AS {encoded("(SELECT id, concat_ws(' ', title, text) AS ptext FROM ps)", "id", "ptext")},
tpairs AS (SELECT q.qid, p.id, {ham_vec('q.embedding', 'p.embedding')} AS distance,
                  {ip_sign('q.embedding', 'p.embedding')} AS score FROM qv q, pv p),
tcand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS crn
                         FROM tpairs) WHERE crn <= {binary_k}),
thits0 AS (SELECT * FROM (SELECT qid, id, distance, score,
                  row_number() OVER (PARTITION BY qid ORDER BY score DESC, distance, id) AS rank
                  FROM tcand) WHERE rank <= {k}),
thits AS (SELECT h.*, p.title, p.text, q.answers FROM thits0 h JOIN ps p ON p.id = h.id JOIN qs q ON q.qid = h.qid),
tans AS (SELECT qid, id, unnest(answers) AS answer, generate_subscripts(answers, 1) - 1 AS idx FROM thits),
tmatch AS (SELECT a.qid, a.id, a.idx, a.answer, concat_ws(' ', h.title, h.text) AS passage
           FROM tans a JOIN thits h ON h.qid = a.qid AND h.id = a.id),
tflag AS (SELECT h.qid, h.id, h.rank, h.distance, h.score,
                 coalesce(bool_or({dpr_string('m.answer', 'm.passage')}), false) AS has_answer
          FROM thits h LEFT JOIN tmatch m ON m.qid = h.qid AND m.id = h.id
          GROUP BY h.qid, h.id, h.rank, h.distance, h.score)"""


SQL["h1_nfd"] = f"SELECT doc_id, {nfd('text')} AS nfd_text FROM documents"
SQL["h1_nfkc"] = "SELECT doc_id, nfc_normalize(text) AS nfkc_text FROM documents"
SQL["h2_word_tokens"] = f"""
SELECT doc_id, len({tokens('text')})::BIGINT AS n_tokens, array_to_string({tokens('text')}, ' ') AS tokens
FROM documents"""
SQL["b1_clean_question"] = """
SELECT conv_id, turn, rtrim(text || repeat('?', (turn % 3)::INT), '?') AS question
FROM conversations WHERE role = 'user'"""


def norm_dpr(x: str) -> str:
    t = f"lower({nfd(x)})"
    t = f"regexp_replace({t}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    art = "'([^\\p{L}\\p{N}_])(a|an|the)([^\\p{L}\\p{N}_])'"
    t = f"regexp_replace(regexp_replace(' ' || {t} || ' ', {art}, '\\1 \\3', 'g'), {art}, '\\1 \\3', 'g')"
    return collapse(t)


SQL["h5_normalize_answer"] = f"""
WITH a AS (SELECT qid, unnest(answers) AS answer, generate_subscripts(answers, 1) - 1 AS idx FROM {QUESTIONS})
SELECT qid, idx::BIGINT AS idx, {norm_dpr('answer')} AS n_dpr,
       {collapse(f"lower({nfd('answer')})")} AS n_simple_nfd,
       {collapse("lower(nfc_normalize(answer))", "")} AS n_simple_nfkc,
       answer AS n_none
FROM a"""

SQL["j1_encode_questions"] = f"""
WITH qs AS {QUESTIONS}
SELECT qid, array_to_string(list_transform(embedding, lambda x: x::INT::VARCHAR), ',') AS vec
FROM {encoded("(SELECT qid, rtrim(question, '?') AS qtext FROM qs)", "qid", "qtext")}"""

SQL["j2_encode_passages"] = f"""
WITH ps AS {PASSAGES}
SELECT id, array_to_string(list_transform(embedding, lambda x: x::INT::VARCHAR), ',') AS vec
FROM {encoded("(SELECT id, concat_ws(' ', title, text) AS ptext FROM ps)", "id", "ptext")}"""

SQL["c5_has_answer_hits"] = f"""
WITH {text_hits(20, 100)}
SELECT qid, rank::BIGINT AS rank, id, distance, round(score, 6) AS score, has_answer FROM tflag"""

SQL["p3_text_recall"] = f"""
WITH {text_hits(20, 100)},
ranks AS (SELECT q.qid, min(f.rank) FILTER (WHERE f.has_answer)::BIGINT AS positive_rank
          FROM qs q LEFT JOIN tflag f ON f.qid = q.qid GROUP BY q.qid)
SELECT k::BIGINT AS k, sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END)::BIGINT AS n_correct,
       count(*)::BIGINT AS n_questions,
       round(sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall
FROM ranks, (SELECT unnest([1, 5, 20]) AS k) ks GROUP BY k"""

SQL["h3_match_types"] = f"""
WITH {text_hits(20, 100)}
SELECT qid, id, idx::BIGINT AS idx,
       {dpr_string('answer', 'passage')} AS m_dpr_string,
       regexp_matches({nfd('passage')}, {nfd('answer')}, 'i') AS m_dpr_regex,
       contains({collapse(f"lower({nfd('passage')})")}, {collapse(f"lower({nfd('answer')})")}) AS m_simple_nfd,
       contains({collapse("lower(nfc_normalize(passage))")}, {collapse("lower(nfc_normalize(answer))")})
         AS m_simple_nfkc,
       contains(passage, answer) AS m_none
FROM tmatch"""


# ---------------------------------------------------------------- reader
NUM_PASSAGES, MAX_LOAD, MAX_LEN, MAX_ANS = 8, 20, 350, 10


def padded_input(q: str, part: str) -> str:
    body = f"(['[CLS]'] || {q} || ['[SEP]'] || {part} || ['[SEP]'])"
    return f"({body} || list_transform(range(0, greatest(0, {MAX_LEN} - len({body}))), lambda i: '[PAD]'))"


PAD_TOKENS = f"(['[CLS]', '[SEP]', '[SEP]', '[SEP]'] || list_transform(range(0, {MAX_LEN - 4}), lambda i: '[PAD]'))"
PAD_WINDOW = f"0 AS win, 0 AS first, {MAX_LEN} AS stop"


def windows(name: str, source: str) -> str:
    """CTEs ending in `name`: `source` (title, text, q_tokens, overlap, ...) by window (win, "offset", first, stop, tokens)."""
    return f"""
{name}_p AS MATERIALIZED (SELECT * EXCLUDE (title, text), ({tokens("coalesce(title, '')")} || ['[SEP]'] || {tokens("coalesce(text, '')")}) AS p,
             greatest(0, {MAX_LEN} - len(q_tokens) - 3) AS room FROM {source}),
{name}_s AS (SELECT *, greatest(1, room - least(overlap, room - 1)) AS stride FROM {name}_p),
{name}_l AS (SELECT *, CASE WHEN len(p) <= room OR room = 0 THEN 0 ELSE ceil((len(p) - room) / stride)::INT END AS last FROM {name}_s),
{name}_w AS (SELECT * EXCLUDE (p), unnest(list_transform(range(0, last + 1), lambda w:
               {{'win': w, 'part': p[w * stride + 1 : w * stride + room]}})) AS w FROM {name}_l),
{name} AS MATERIALIZED (SELECT * EXCLUDE (w), w.win::INT AS win, (w.win * stride)::INT AS "offset",
               CASE WHEN w.win = 0 THEN 0 ELSE len(q_tokens) + 2 END AS first,
               CASE WHEN w.win = last THEN greatest({MAX_LEN}, len(q_tokens) + 3) ELSE len(q_tokens) + 2 + stride END AS stop,
               {padded_input('q_tokens', 'w.part')} AS tokens FROM {name}_w)"""


def answer_spans(tok: str, a_tokens: str) -> str:
    st = f"greatest(coalesce(list_position({tok}, '[SEP]'), 0) - 1, 0)"
    return (f"flatten(list_transform(list_filter({a_tokens}, lambda a: len(a) > 0), lambda a: "
            f"list_transform(list_filter(range({st}, len({tok}) - len(a) + 1), "
            f"lambda i: {tok}[i + 1 : i + len(a)] = a), lambda i: {{'start': i, 'end': i + len(a) - 1}})))")


def spans_str(sp: str) -> str:
    return f"array_to_string(list_transform({sp}, lambda s: s.start::VARCHAR || '-' || s.end::VARCHAR), ',')"


def ints_str(xs: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda x: x::BIGINT::VARCHAR), ',')"


def logits(pid: str, tok: str, q: str, mul: int, add: int, mod: int) -> str:
    return (f"list_transform({tok}, lambda t, i: (((({pid}) * {mul} + (i - 1) * {add}) % {mod} + {mod}) % {mod} "
            f"+ CASE WHEN list_contains({q}, t) THEN 5 ELSE 0 END)::DOUBLE)")


def ranked_spans(st: str, en: str, first: str = "first", stop: str = "stop") -> str:
    return (f"list_sort(flatten(list_transform(range({first}, least({stop}, len({st}))), lambda s: "
            f"list_transform(range(s, least(s + {MAX_ANS}, len({st}))), lambda e: "
            f"{{'neg': -({st}[s + 1] + {en}[e + 1]), 'start': s, 'end': e, "
            f"'sl': {st}[s + 1], 'el': {en}[e + 1]}}))))")


def greedy_spans(ranked: str, n: int) -> str:
    nested = ("coalesce(list_bool_or(list_transform(acc, lambda y: (x.start <= y.start AND y.end <= x.end) "
              "OR (y.start <= x.start AND x.end <= y.end))), false)")
    empty = "[]::STRUCT(neg DOUBLE, start BIGINT, \"end\" BIGINT, sl DOUBLE, el DOUBLE)[]"
    return (f"list_reduce({ranked}, lambda acc, x: CASE WHEN len(acc) < {n} AND NOT {nested} "
            f"THEN list_append(acc, x) ELSE acc END, {empty})")


def detok(xs: str) -> str:
    return f"trim(replace(array_to_string({xs}, ' '), ' ##', ''))"


SCORES = f"""*, (((pid % 23) + 23) % 23 + len(list_intersect(q_tokens, tokens)))::DOUBLE AS classifier_logit,
                  {logits('pid', 'tokens', 'q_tokens', 7, 13, 17)} AS start_logits,
                  {logits('pid', 'tokens', 'q_tokens', 11, 5, 19)} AS end_logits"""

READER = f"""
WITH {text_hits(20, 100)},
qtok AS (SELECT *, greatest({MAX_ANS}, coalesce(list_max(list_transform(a_tokens, lambda a: len(a))), 0)) - 1 AS overlap FROM (
           SELECT qid, {tokens("rtrim(question, '?')")} AS q_tokens,
                  list_transform(answers, lambda a: {tokens('a')}) AS a_tokens, answers FROM qs)),
ctx AS (SELECT f.qid, (f.rank - 1)::INT AS idx, f.id AS pid, p.title, p.text, f.has_answer
        FROM tflag f JOIN ps p ON p.id = f.id WHERE f.rank <= {MAX_LOAD}),
asked AS (SELECT c.*, t.q_tokens, t.a_tokens, t.overlap FROM ctx c JOIN qtok t ON t.qid = c.qid),
{windows('loaded0', 'asked')},
loaded AS (SELECT *, {answer_spans('tokens', 'a_tokens')} AS spans FROM loaded0),
flags AS (SELECT *, coalesce(has_answer, false) AND len(spans) > 0 AS is_positive,
                 NOT coalesce(has_answer, false) AS is_negative FROM loaded),
posneg AS (SELECT t.qid,
                  coalesce(list_sort(list(DISTINCT f.idx) FILTER (WHERE f.is_positive)), []) AS positive_idxs,
                  coalesce(list_sort(list(DISTINCT f.idx) FILTER (WHERE f.is_negative)), []) AS negative_idxs
           FROM qtok t LEFT JOIN flags f ON f.qid = t.qid GROUP BY t.qid),
nload AS (SELECT t.qid, count(c.idx) AS n FROM qtok t LEFT JOIN ctx c ON c.qid = t.qid GROUP BY t.qid),
slots AS (SELECT qid, idx AS slot, idx, win, first, stop, "offset", pid, q_tokens, tokens FROM loaded WHERE idx < {NUM_PASSAGES}
          UNION ALL
          SELECT qid, s AS slot, -1 AS idx, {PAD_WINDOW}, 0 AS "offset", -1 AS pid, []::VARCHAR[] AS q_tokens, {PAD_TOKENS} AS tokens
          FROM (SELECT qid, unnest(range(n::INT, {NUM_PASSAGES})) AS s FROM nload)),
scores AS MATERIALIZED (SELECT {SCORES} FROM slots)"""


def candidates(n_read: int, n_spans: int) -> str:
    return f""",
bestw AS (SELECT *, max(classifier_logit) OVER (PARTITION BY qid, slot) AS best_logit FROM scores),
readp AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY best_logit DESC, slot) AS passage_rank
          FROM bestw QUALIFY passage_rank <= {n_read}),
tops AS MATERIALIZED (SELECT * EXCLUDE (start_logits, end_logits), {ranked_spans('start_logits', 'end_logits')}[1:{n_spans}] AS found FROM readp),
sp0 AS (SELECT qid, slot, idx, win, "offset", passage_rank, q_tokens, tokens, classifier_logit,
               unnest(found) AS s, generate_subscripts(found, 1) AS nth FROM tops),
sp AS (SELECT *, row_number() OVER (PARTITION BY qid, slot ORDER BY classifier_logit + s.sl + s.el DESC, win, nth) AS span_rank
       FROM sp0 QUALIFY span_rank <= {n_spans}),
tx AS (SELECT *, {detok('tokens')} AS input_text, {detok('tokens[1:s.start]')} AS left_text,
              {detok('tokens[s.start + 1 : s.end + 1]')} AS answer_text FROM sp),
cands AS (SELECT qid, slot, idx, win, s.start AS span_start, s."end" AS span_end, input_text, answer_text,
                 CASE WHEN s.start >= len(q_tokens) + 2 THEN s.start - len(q_tokens) - 2 + "offset" END AS passage_start,
                 CASE WHEN instr(substring(input_text, length(left_text) + 1), answer_text) = 0 THEN -1
                      ELSE instr(substring(input_text, length(left_text) + 1), answer_text) + length(left_text) - 1
                 END AS answer_start,
                 classifier_logit AS classifier_score, s.sl + s.el AS span_score,
                 classifier_logit + s.sl + s.el AS score,
                 row_number() OVER (PARTITION BY qid ORDER BY classifier_logit + s.sl + s.el DESC,
                                    passage_rank, span_rank) AS rank
          FROM tx)"""


CAND_COLS = """qid, rank::BIGINT AS rank, slot::BIGINT AS slot, win::BIGINT AS win, passage_start::BIGINT AS passage_start, span_start::BIGINT AS span_start,
       span_end::BIGINT AS span_end, answer_text, answer_start::BIGINT AS answer_start,
       (answer_start + length(answer_text))::BIGINT AS answer_end, round(score, 6) AS score,
       round(classifier_score, 6) AS classifier_score, round(span_score, 6) AS span_score"""

SQL["p4_reader_set"] = f"""
WITH {text_hits(20, 100)}
SELECT q.qid, count(f.id)::BIGINT AS n_ctxs,
       coalesce(array_to_string(list(f.id::VARCHAR ORDER BY f.rank), ','), '') AS ctx_ids,
       coalesce(array_to_string(list(CASE WHEN f.has_answer THEN '1' ELSE '0' END ORDER BY f.rank), ''), '')
         AS has_answer
FROM qs q LEFT JOIN tflag f ON f.qid = q.qid GROUP BY q.qid"""

SQL["h19_reader_input"] = READER + """
SELECT qid, slot::BIGINT AS slot, idx::BIGINT AS idx, win::BIGINT AS win, array_to_string(tokens, ' ') AS tokens FROM slots"""

SQL["h20_answer_spans"] = READER + f"""
SELECT qid, idx::BIGINT AS idx, win::BIGINT AS win, {spans_str('spans')} AS spans FROM loaded"""

SQL["b11_positive_negative"] = READER + f"""
SELECT qid, {ints_str('positive_idxs')} AS positive_idxs, {ints_str('negative_idxs')} AS negative_idxs FROM posneg"""

SQL["j3_reader_logits"] = READER + f"""
SELECT qid, slot::BIGINT AS slot, win::BIGINT AS win, classifier_logit, {ints_str('start_logits')} AS start_logits,
       {ints_str('end_logits')} AS end_logits FROM scores"""

SQL["f4_passages_to_read"] = READER + """
SELECT qid, passage_rank::BIGINT AS passage_rank, slot::BIGINT AS slot, idx::BIGINT AS idx FROM (
  SELECT qid, slot, idx, row_number() OVER (PARTITION BY qid ORDER BY max(classifier_logit) DESC, slot) AS passage_rank
  FROM scores GROUP BY qid, slot, idx)
WHERE passage_rank <= 3"""

SQL["f5_best_spans"] = READER + f""",
ranked AS MATERIALIZED (SELECT qid, slot, win, {ranked_spans('start_logits', 'end_logits')} AS found FROM scores)
SELECT qid, slot::BIGINT AS slot, win::BIGINT AS win, {spans_str('found[1:3]')} AS spans_overlap,
       {spans_str(greedy_spans('found', 3))} AS spans_nested_off
FROM ranked"""

_SUB = "starts_with(tok[p + 1], '##')"
SQL["h17_subword_edges"] = f"""
WITH w AS (SELECT item_id AS qid, {tokens('text')} AS words FROM benchmark),
t AS (SELECT qid, flatten(list_transform(words, lambda w: CASE WHEN length(w) > 4 THEN [w[1:4], '##' || w[5:]] ELSE [w] END)) AS tok FROM w),
l AS (SELECT *, {logits('qid', 'tok', '[]::VARCHAR[]', 7, 13, 17)} AS st, {logits('qid', 'tok', '[]::VARCHAR[]', 11, 5, 19)} AS en FROM t),
r AS MATERIALIZED (SELECT qid, tok, {ranked_spans('st', 'en', '0', 'len(tok)').replace(f"s + {MAX_ANS}", "s + 5")}[1:3] AS found FROM l),
f AS (SELECT qid, tok, unnest(found) AS s, generate_subscripts(found, 1) - 1 AS nth FROM r),
g AS (SELECT qid, tok, nth, list_max(list_filter(range(0, s.start + 1), lambda p: p = 0 OR NOT {_SUB})) AS b,
             coalesce(list_min(list_filter(range(s."end" + 1, len(tok)), lambda p: NOT {_SUB})), len(tok)) - 1 AS e FROM f)
SELECT qid, nth::BIGINT AS nth, b::BIGINT AS span_start, e::BIGINT AS span_end, {detok('tok[b + 1 : e + 1]')} AS answer_text FROM g"""

SQL["f6_answer_candidates"] = READER + candidates(2, 2) + f"\nSELECT {CAND_COLS} FROM cands"

_HL = "input_text[:answer_start] || '**' || answer_text || '**' || input_text[answer_start + length(answer_text) + 1:]"
SQL["h23_highlight"] = READER + candidates(1, 1) + f"""
SELECT qid, trim(replace(replace(replace(replace(replace(replace(replace({_HL}, '[PAD]', ''),
  '[UNK]', '`[UNK]`'), '[SEP]', '`[SEP]`'), '[PAD]', '`[PAD]`'), '[CLS]', '`[CLS]`'), '[MASK]', '`[MASK]`'),
  '``', '')) AS highlighted FROM cands"""

SQL["d4_classifier_precision"] = READER + """,
top AS (SELECT qid, idx FROM scores QUALIFY row_number() OVER (PARTITION BY qid ORDER BY classifier_logit DESC, slot, win) = 1)
SELECT round(avg(CASE WHEN list_contains(p.positive_idxs, t.idx) THEN 1.0 ELSE 0.0 END), 6) AS classifier_precision,
       count(*)::BIGINT AS n_questions
FROM top t JOIN posneg p ON p.qid = t.qid"""

SQL["d5_answer_accuracy"] = READER + candidates(1, 1) + f""",
gold AS (SELECT qid, list_distinct(list_transform(answers, lambda a: {norm_dpr('a')})) AS gold FROM qtok),
pred AS (SELECT qid, {norm_dpr('answer_text')} AS pred FROM cands WHERE rank = 1)
SELECT round(avg(CASE WHEN coalesce(list_contains(g.gold, p.pred), false) THEN 1.0 ELSE 0.0 END), 6)
         AS answer_accuracy, count(*)::BIGINT AS n_questions
FROM qtok q LEFT JOIN pred p ON p.qid = q.qid LEFT JOIN gold g ON g.qid = q.qid"""

SQL["h4_sublist_positions"] = f"""
WITH q AS (SELECT item_id AS qid, {tokens('text')} AS t FROM benchmark),
g AS (SELECT qid, t, unnest(range(0, greatest(len(t) - 2, 0))) AS g FROM q)
SELECT qid, g::BIGINT AS g,
       {ints_str("list_filter(range(0, len(t) - 2), lambda i: t[i + 1 : i + 3] = t[g + 1 : g + 3])")} AS positions
FROM g"""

def p6_sql(questions: str = QUESTIONS) -> str:
    return f"""
WITH {text_hits(10, 100, questions)},
qtok AS (SELECT qid, {tokens("rtrim(question, '?')")} AS q_tokens FROM qs),
asked AS (SELECT h.qid, (h.rank - 1)::INT AS slot, (h.rank - 1)::INT AS idx, h.id AS pid, t.q_tokens, h.title, h.text, {MAX_ANS - 1} AS overlap
          FROM thits h JOIN qtok t ON t.qid = h.qid),
{windows('slots', 'asked')},
scores AS MATERIALIZED (SELECT {SCORES} FROM slots)""" + candidates(3, 1) + f"\nSELECT {CAND_COLS} FROM cands"


SQL["p6_batch_qa"] = p6_sql()


# ---------------------------------------------------------------- sources, store
SQL["a1_passage_tsv"] = """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS dataset, md5(text) AS text_md5,
       (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos
FROM documents"""

SQL["a4_passage_store"] = """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS dataset, md5(text || ' [r2]') AS text_md5
FROM documents"""

SQL["a5_store_key_order"] = """
SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id::VARCHAR) - 1)::BIGINT AS pos FROM documents"""

SQL["a6_store_size"] = "SELECT count(*)::BIGINT AS n_passages FROM documents"

SQL["a7_lookup"] = """
SELECT l.doc_id AS id, l.quality, split_part(d.text, chr(10), 1) AS title, md5(d.text || ' [r2]') AS text_md5
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""

SQL["a8_passage_table"] = "SELECT doc_id AS id, upper(source) AS dataset, md5(text) AS text_md5 FROM documents"

SQL["a9_qa_tsv"] = f"""
SELECT (row_number() OVER (ORDER BY qid) - 1)::BIGINT AS pos, question, array_to_string(answers, '|') AS answers,
       len(answers)::BIGINT AS n_answers
FROM {QUESTIONS}"""

SQL["a15_concat_files"] = """
WITH f AS (SELECT 0 AS file_no, item_id AS k1, 0 AS k2, text AS q FROM benchmark
           UNION ALL SELECT 1, conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT (row_number() OVER (ORDER BY file_no, k1, k2) - 1)::BIGINT AS index, file_no::BIGINT AS file_no,
       md5(q) AS q_md5 FROM f"""

SQL["a16_batches"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark)
SELECT (pos // 7)::BIGINT AS batch_id, count(*)::BIGINT AS n, min(pos)::BIGINT AS first_pos FROM p GROUP BY 1"""

SQL["a17_reader_set_json"] = f"""
WITH {text_hits(20, 100)},
r AS (SELECT q.qid, count(f.id)::BIGINT AS n_ctxs,
       coalesce(array_to_string(list(f.id::VARCHAR ORDER BY f.rank), ','), '') AS ctx_ids,
       coalesce(array_to_string(list(CASE WHEN f.has_answer THEN '1' ELSE '0' END ORDER BY f.rank), ''), '')
         AS has_answer
      FROM qs q LEFT JOIN tflag f ON f.qid = q.qid GROUP BY q.qid)
SELECT r.qid, v.form, r.n_ctxs, r.ctx_ids, r.has_answer FROM r, (VALUES ('lines'), ('array')) v(form)"""

SQL["a14_vector_table"] = SQL["h7_pack_bits"]


# ---------------------------------------------------------------- training sets
def H(*parts: str) -> str:
    """Seeded hash: first 8 hex digits of md5 of the '|'-joined parts, as BIGINT."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT)"


def shuffled(arr: str, *key: str) -> str:
    return (f"list_transform(list_sort(list_transform({arr}, lambda x, i: "
            f"{{'h': {H(*key, '(i - 1)')}, 'i': i - 1, 'x': x}})), lambda s: s.x)")


def _ids(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda x: x.id), ',')"


RETRIEVER_ITEMS = f"""
rh AS (SELECT f.qid, f.id, f.rank, f.has_answer, p.title, p.text, p.dataset, l.quality
       FROM tflag f JOIN ps p ON p.id = f.id LEFT JOIN labels l ON l.doc_id = f.id),
items AS (SELECT qid,
  coalesce(list({{'id': id::VARCHAR, 'title': title, 'text': text}} ORDER BY rank) FILTER (WHERE has_answer), [])
    AS positives,
  coalesce(list({{'id': id::VARCHAR, 'title': NULL::VARCHAR, 'text': NULL::VARCHAR}} ORDER BY rank)
    FILTER (WHERE NOT has_answer AND quality = 0), []) AS hard,
  coalesce(list({{'id': id::VARCHAR, 'title': title, 'text': text}} ORDER BY rank)
    FILTER (WHERE NOT has_answer AND (quality IS NULL OR quality = 1)), []) AS normal,
  arg_min(dataset, rank) AS dataset
  FROM rh GROUP BY qid),
ex AS (SELECT i.qid, q.question, i.dataset, i.positives[1:3] AS positives, i.hard[1:5] AS hard,
              i.normal[1:5] AS normal
       FROM items i JOIN qs q ON q.qid = i.qid
       WHERE len(i.positives[1:3]) > 0 AND len(i.hard[1:5]) + len(i.normal[1:5]) > 0),
nex AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS index FROM ex)"""

SQL["a10_retriever_file"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS}
SELECT md5(q.question) AS q_md5, {_ids('i.positives')} AS positive_ids, i.dataset
FROM items i JOIN qs q ON q.qid = i.qid"""

SQL["a11_retriever_examples"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS}
SELECT index::BIGINT AS index, dataset, {_ids('positives')} AS positives, {_ids('hard')} AS hard_negatives,
       {_ids('normal')} AS normal_negatives, '{{"extra":{{"list":[' || qid || ',null],"note":"free"}},"qid":' || qid || '}}' AS metadata
FROM nex"""

SQL["b3_dataset_keys"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS}
SELECT (row_number() OVER (ORDER BY qid) - 1)::BIGINT AS index, dataset, md5(question) AS q_md5
FROM ex WHERE dataset IN ('src0', 'src2')"""

SQL["p7_biencoder_pairs"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS},
picked AS (SELECT index, positives[({H("11", "1", "'pos'", "index")} % len(positives)) + 1] AS pos,
                  ({shuffled('hard', "11", "1", "'hard'", "index")} ||
                   {shuffled('normal', "11", "1", "'normal'", "index")})[1:1] AS negs
           FROM nex),
pairs AS (SELECT index, unnest(list_prepend(pos, negs)) AS p,
                 generate_subscripts(list_prepend(pos, negs), 1) - 1 AS slot FROM picked)
SELECT index::BIGINT AS index, slot::BIGINT AS slot, p.id AS passage_id,
       md5(coalesce(p.title, split_part(d.text, chr(10), 1))) AS title_md5, md5(coalesce(p.text, d.text)) AS text_md5
FROM pairs LEFT JOIN documents d ON d.doc_id = p.id::BIGINT"""

SQL["d7_dataset_sizes"] = """
SELECT source AS dataset, count(*)::BIGINT AS n_examples FROM documents GROUP BY ROLLUP (source)"""

SQL["i1_multi_key_batches"] = f"""
WITH ex AS (SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS key_idx
            FROM documents),
w AS (SELECT *, (CASE dataset WHEN 'src0' THEN 2.5 WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.29 ELSE 1.0 END)::DOUBLE
                AS w FROM ex),
sizes AS (SELECT dataset, floor(count(*) * any_value(w))::BIGINT AS take FROM w GROUP BY dataset),
reps AS (SELECT *, unnest(range(0, floor(w)::INT + 1)) AS rep FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rep, {H("3", "1", "dataset", "rep", "key_idx")},
                                        key_idx) - 1 AS pos FROM reps),
kept AS (SELECT r.dataset, r.key_idx, r.pos // 8 AS chunk, r.pos % 8 AS slot
         FROM ranked r JOIN sizes s ON s.dataset = r.dataset
         WHERE r.pos < s.take AND r.pos // 8 < s.take // 8),
chunks AS (SELECT dataset, chunk, row_number() OVER (ORDER BY {H("3", "1", "'chunk'", "dataset", "chunk")},
                                                      dataset, chunk) - 1 AS batch_no
           FROM (SELECT DISTINCT dataset, chunk FROM kept))
SELECT c.batch_no::BIGINT AS batch_no, (k.slot // 2)::BIGINT AS batch_pos, k.dataset, k.key_idx::BIGINT AS key_idx
FROM kept k JOIN chunks c ON c.dataset = k.dataset AND c.chunk = k.chunk WHERE k.slot % 2 = 1"""

SQL["i9_plain_batches"] = f"""
WITH o AS (SELECT doc_id AS index, row_number() OVER (ORDER BY {H("5", "2", "doc_id")}, doc_id) - 1 AS pos
           FROM documents),
m AS (SELECT index, pos // 2 AS p FROM o WHERE pos % 2 = 0)
SELECT index, (p // 6)::BIGINT AS batch_id, (p % 6)::BIGINT AS batch_pos FROM m"""

def train(lists: str, flags: str = "flags", spans: int = 3) -> str:
    """CTEs from `lists` (qid, pos, neg) to tscores (a row per slot, its window drawn) and padded (slot 0's spans)."""
    pads = "list_transform(range(0, greatest(0, 4 - len(b))), lambda i: -1)"

    def padded(value: str, fill: str = "0") -> str:
        return f"list_transform(spans[1:{spans}], lambda s: {value}) || list_transform(range(0, {spans} - len(spans[1:{spans}])), lambda i: {fill})"

    return f""",
{lists},
body AS (SELECT qid, [pos[({H("9", "0", "'rpos'", "qid")} % len(pos)) + 1]] ||
                     {shuffled('neg', "9", "0", "'rneg'", "qid")}[1:3] AS b
         FROM lists WHERE len(pos) > 0),
tslots AS (SELECT qid, unnest(b || {pads}) AS idx, generate_subscripts(b || {pads}, 1) - 1 AS slot FROM body),
trows AS (SELECT t.qid, t.slot, t.idx, f.win, f.pid, f.q_tokens, f.tokens, f.spans
          FROM tslots t JOIN {flags} f ON f.qid = t.qid AND f.idx = t.idx WHERE t.slot > 0 OR len(f.spans) > 0
          QUALIFY row_number() OVER (PARTITION BY t.qid, t.slot ORDER BY {H("9", "0", "'rwin'", "t.qid", "t.idx", "f.win")}, f.win) = 1
          UNION ALL
          SELECT qid, slot, idx, 0 AS win, -1 AS pid, []::VARCHAR[] AS q_tokens, {PAD_TOKENS} AS tokens, [] AS spans FROM tslots WHERE idx < 0),
tscores AS (SELECT {SCORES} FROM trows),
padded AS (SELECT qid, slot, start_logits, end_logits, {padded('s.start')} AS starts, {padded('s.end')} AS ends, {padded('1')} AS mask
           FROM tscores)"""


_LISTS = """lists AS (SELECT qid, coalesce(list_sort(list(DISTINCT idx) FILTER (WHERE is_positive)), [])[1:3] AS pos,
                 coalesce(list_sort(list(DISTINCT idx) FILTER (WHERE is_negative)), [])[1:10] AS neg
          FROM flags GROUP BY qid)"""
TRAIN = READER + train(_LISTS)

SQL["i6_reader_training_slots"] = TRAIN + "\nSELECT qid, slot::BIGINT AS slot, idx::BIGINT AS idx FROM tslots"

SQL["h21_padded_spans"] = TRAIN + f"""
SELECT qid, {ints_str('starts')} AS starts, {ints_str('ends')} AS ends, {ints_str('mask')} AS mask FROM padded WHERE slot = 0"""

SQL["d12_classifier_loss"] = TRAIN + """,
z AS (SELECT qid, slot, CASE WHEN idx >= 0 THEN classifier_logit ELSE -1e8 END AS z FROM tscores),
per_q AS (SELECT qid, max(z) AS mx, any_value(z) FILTER (WHERE slot = 0) AS zl FROM z GROUP BY qid),
lse AS (SELECT z.qid, ln(sum(exp(z.z - p.mx))) + p.mx - p.zl AS loss FROM z JOIN per_q p ON p.qid = z.qid
        GROUP BY z.qid, p.mx, p.zl)
SELECT round(sum(loss), 6) AS classifier_loss FROM lse"""


def log_softmax_at(arr: str, pos: str) -> str:
    return (f"({arr}[{pos} + 1] - (ln(list_sum(list_transform({arr}, lambda x: exp(x - list_max({arr}))))) "
            f"+ list_max({arr})))")


SQL["d13_span_loss"] = TRAIN + f""",
probs AS (SELECT qid, list_sum(list_transform(range(1, 4), lambda j: CASE WHEN mask[j] = 1 THEN
            exp({log_softmax_at('start_logits', 'starts[j]')} + {log_softmax_at('end_logits', 'ends[j]')})
            ELSE 0.0 END)) AS total FROM padded WHERE slot = 0)
SELECT round(sum(-ln(total)), 6) AS span_loss FROM probs"""


# ---------------------------------------------------------------- evaluation modes, gold, P9, K1
QMAP = "qmap AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS qidx FROM qs)"


def recall_sql(ranks: str, ks: str) -> str:
    return f"""
SELECT k::BIGINT AS k, sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END)::BIGINT AS n_correct,
       count(*)::BIGINT AS n_questions,
       round(sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall
FROM {ranks}, (SELECT unnest({ks}) AS k) ks GROUP BY k"""


SQL["c6_labelled_positive_recall"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS},
pos AS (SELECT qid, list_transform(positives, lambda x: x.id) AS pids FROM items),
f AS (SELECT h.qid, h.rank, list_contains(p.pids, h.id::VARCHAR) AS is_positive
      FROM tflag h JOIN pos p ON p.qid = h.qid),
ranks AS (SELECT q.qid, min(f.rank) FILTER (WHERE f.is_positive)::BIGINT AS positive_rank
          FROM qs q LEFT JOIN f ON f.qid = q.qid GROUP BY q.qid)""" + recall_sql("ranks", "[1, 5, 20]")

_HELD = f"""
held AS (SELECT q.qid, list(d.doc_id) AS ids, arg_min(d.source, d.doc_id) AS dataset FROM qs q JOIN documents d
         ON contains({joined(tokens(nfd('d.text')))}, {joined(tokens(nfd('q.question')))}) GROUP BY q.qid)"""
_PLACED = "placed AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM qs)"
SQL["p3_labelled_positives"] = f"""
WITH {text_hits(20, 100)},{_HELD},
ranks AS (SELECT q.qid, min(h.rank) FILTER (WHERE list_contains(l.ids, h.id)) AS positive_rank
          FROM qs q LEFT JOIN thits0 h ON h.qid = q.qid LEFT JOIN held l ON l.qid = q.qid GROUP BY q.qid)""" + recall_sql("ranks", "[1, 5, 20]")
SQL["p3_same_dataset"] = f"""
WITH {text_hits(20, 100)},{_HELD},{_PLACED},
kept AS (SELECT h.qid, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS rank,
                coalesce(list_bool_or(list_transform(h.answers, lambda a: {dpr_string('a', 'h.text')})), false) AS has_answer
         FROM thits h JOIN ps p ON p.id = h.id LEFT JOIN held l ON l.qid = h.qid WHERE p.dataset = coalesce(l.dataset, 'src1'))
SELECT p.place AS qid, min(k.rank) FILTER (WHERE k.has_answer)::BIGINT AS positive_rank
FROM placed p LEFT JOIN kept k ON k.qid = p.qid GROUP BY p.place"""
SQL["p3_qa_files"] = f"""
WITH qs AS {QUESTIONS}, ps AS {PASSAGES},
qv AS {encoded("(SELECT qid, rtrim(question, '?') AS qtext FROM qs)", "qid", "qtext")},
pv AS {encoded("(SELECT id, concat_ws(' ', title, text) AS ptext FROM ps)", "id", "ptext")},
pairs AS (SELECT q.qid, p.id, {ip('q.embedding', 'p.embedding')} AS score FROM qv q, pv p),
best AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 20),
asked AS (SELECT b.qid, b.rank, concat_ws(' ', p.title, p.text) AS passage, unnest(q.answers) AS answer
          FROM best b JOIN ps p ON p.id = b.id JOIN qs q ON q.qid = b.qid),
ranks AS (SELECT q.qid, min(a.rank) FILTER (WHERE {dpr_string('a.answer', 'a.passage')}) AS positive_rank
          FROM qs q LEFT JOIN asked a ON a.qid = q.qid GROUP BY q.qid)
SELECT k::BIGINT AS k, sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END)::BIGINT AS n_correct, count(*)::BIGINT AS n_questions,
       round(sum(CASE WHEN positive_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall, (SELECT count(*) FROM best)::BIGINT AS n_ctxs
FROM ranks, (SELECT unnest([1, 5, 20]) AS k) ks GROUP BY k"""

SQL["b4_same_dataset_hits"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS},{QMAP},
kept AS (SELECT h.qid, h.id, h.rank FROM tflag h JOIN ps p ON p.id = h.id JOIN items i ON i.qid = h.qid
         WHERE p.dataset = i.dataset)
SELECT m.qidx AS qid, (row_number() OVER (PARTITION BY k.qid ORDER BY k.rank))::BIGINT AS rank, k.id
FROM kept k JOIN qmap m ON m.qid = k.qid"""

GOLD_TOP = """
gtop AS (SELECT h.qid, h.id, p.title, q.question FROM tflag h JOIN ps p ON p.id = h.id JOIN qs q ON q.qid = h.qid
         WHERE h.rank = 1)"""

SQL["a13_gold_passages"] = f"""
WITH {text_hits(20, 100)},{GOLD_TOP}
SELECT DISTINCT md5(k) AS key_md5, id, md5(title) AS title_md5 FROM (
  SELECT question AS k, id, title FROM gtop UNION ALL SELECT lower(question) AS k, id, title FROM gtop)"""

SQL["b9_canonical_question"] = "SELECT item_id AS qid, md5(text) AS q_md5 FROM benchmark"

_C7_LISTS = f"""lists0 AS (SELECT qid, coalesce(list_sort(list(DISTINCT idx) FILTER (WHERE is_positive)), []) AS pos_all,
                 coalesce(list_sort(list(DISTINCT idx) FILTER (WHERE is_negative)), [])[1:10] AS neg
          FROM flags GROUP BY qid),
titles AS (SELECT qid, list(title ORDER BY idx) AS titles FROM ctx GROUP BY qid),{GOLD_TOP},
lists AS (SELECT l.qid,
            CASE WHEN g.title IS NOT NULL
                  AND len(list_filter(l.pos_all, lambda i: lower(t.titles[i + 1]) = lower(g.title))) > 0
                 THEN list_filter(l.pos_all, lambda i: lower(t.titles[i + 1]) = lower(g.title))
                 ELSE l.pos_all[1:3] END AS pos, l.neg
          FROM lists0 l JOIN titles t ON t.qid = l.qid LEFT JOIN gtop g ON g.qid = l.qid)"""
SQL["c7_gold_positives"] = READER + train(_C7_LISTS) + "\nSELECT qid, slot::BIGINT AS slot, idx::BIGINT AS idx FROM tslots"

# The question's own text is its gold passage, behind the loaded ones.
_C8_LISTS = f"""gold AS (SELECT t.qid, n.n AS idx, 1000000 + t.qid AS pid, 'item' AS title, q.question AS text, t.q_tokens, t.a_tokens, t.overlap
          FROM qtok t JOIN qs q ON q.qid = t.qid JOIN nload n ON n.qid = t.qid),
{windows('gold0', 'gold')},
goldw AS (SELECT *, {answer_spans('tokens', 'a_tokens')} AS spans FROM gold0),
allw AS (SELECT qid, idx, win, pid, q_tokens, tokens, spans FROM flags UNION ALL SELECT qid, idx, win, pid, q_tokens, tokens, spans FROM goldw),
gspan AS (SELECT qid, max(idx) AS gidx, bool_or(len(spans) > 0) AS has FROM goldw GROUP BY qid),
lists AS (SELECT p.qid, p.positive_idxs[1:3] || CASE WHEN g.has THEN [g.gidx] ELSE [] END AS pos, p.negative_idxs[1:10] AS neg
          FROM posneg p JOIN gspan g ON g.qid = p.qid)"""
_P8 = READER + train(_C8_LISTS, "allw", spans=8)
SQL["c8_gold_passage"] = _P8 + "\nSELECT qid, slot::BIGINT AS slot, idx::BIGINT AS idx FROM tslots"
SQL["p8_reader_training_table"] = _P8 + f"""
SELECT t.qid, t.slot::BIGINT AS slot, t.idx::BIGINT AS idx, t.win::BIGINT AS win, md5(array_to_string(t.tokens, ' ')) AS tokens_md5,
       {ints_str('p.starts')} AS starts, {ints_str('p.ends')} AS ends, {ints_str('p.mask')} AS mask
FROM tscores t JOIN padded p ON p.qid = t.qid AND p.slot = t.slot"""

SQL["p5_gold_file"] = SQL["d5_answer_accuracy"]

SQL["h22_encoder_input"] = f"""
WITH t AS (SELECT doc_id AS id, {tokens("split_part(text, chr(10), 1)")} AS tt, {tokens('text')} AS xt FROM documents)
SELECT id, array_to_string(['[CLS]'] || tt || ['[SEP]'] || xt[1:greatest(0, 32 - len(tt) - 3)] || ['[SEP]'], ' ')
         AS tokens FROM t"""

SQL["h22_question_input"] = f"""
WITH t AS (SELECT item_id AS qid, {tokens("rtrim(text, '?')")} AS qt FROM benchmark)
SELECT qid, array_to_string(['[CLS]'] || qt[1:14] || ['[SEP]'], ' ') AS tokens FROM t"""

_QV_LIMITED = f"""(SELECT item_id AS qid, array_to_string({tokens("rtrim(text, '?')")}[1:14], ' ') AS qtext FROM benchmark)"""
_PV_LIMITED = f"""(SELECT id, array_to_string(tt || xt[1:greatest(0, 256 - len(tt) - 3)], ' ') AS ptext FROM (
  SELECT id, {tokens("coalesce(title, '')")} AS tt, {tokens("coalesce(text, '')")} AS xt FROM {PASSAGES}))"""
SQL["j1_limited_questions"] = f"""
SELECT qid, array_to_string(list_transform(embedding, lambda x: x::INT::VARCHAR), ',') AS vec FROM {encoded(_QV_LIMITED, "qid", "qtext")}"""
SQL["j2_limited_passages"] = f"""
SELECT id, array_to_string(list_transform(embedding, lambda x: x::INT::VARCHAR), ',') AS vec FROM {encoded(_PV_LIMITED, "id", "ptext")}"""

SQL["d14_merge_shards"] = SQL["d4_classifier_precision"]


def sign_dot(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CASE WHEN {a}[i] < 0 THEN -1.0 ELSE 1.0 END)"
            f" * (CASE WHEN {b}[i] < 0 THEN -1.0 ELSE 1.0 END)))")


SQL["p9_biencoder_eval"] = f"""
WITH {text_hits(20, 100)},{RETRIEVER_ITEMS},
picked AS (SELECT index, qid, positives[1] AS pos, (hard || normal)[1:1] AS negs FROM nex),
pairs AS (SELECT index, unnest(list_prepend(pos, negs)) AS p, generate_subscripts(list_prepend(pos, negs), 1) - 1
                   AS slot FROM picked),
filled AS (SELECT index, slot, coalesce(p.title, split_part(d.text, chr(10), 1)) AS title,
                  coalesce(p.text, d.text) AS text
           FROM pairs LEFT JOIN documents d ON d.doc_id = p.id::BIGINT),
qsrc AS (SELECT n.index, rtrim(q.question, '?') AS qtext FROM nex n JOIN qs q ON q.qid = n.qid),
qvec AS {encoded('qsrc', 'index', 'qtext')},
psrc AS (SELECT index * 10 + slot AS pk, index, slot, concat_ws(' ', title, text) AS ptext FROM filled),
pvec AS {encoded('psrc', 'pk', 'ptext')},
qb AS (SELECT index // 4 AS b, index % 4 AS bp, embedding AS qv FROM qvec),
pb AS (SELECT s.index // 4 AS b, s.index % 4 AS bp, s.slot, v.embedding AS pv FROM pvec v JOIN psrc s ON s.pk = v.pk),
sc AS (SELECT q.b, q.bp AS qi, (p.bp = q.bp AND p.slot = 0) AS is_label, {ip('q.qv', 'p.pv')} AS s,
              {sign_dot('q.qv', 'p.pv')} AS sb, {ip_sign('q.qv', 'p.pv')} AS sr
       FROM qb q JOIN pb p ON p.b = q.b),
perq AS (SELECT b, qi, max(s) AS mx, max(sr) AS mxr, any_value(s) FILTER (WHERE is_label) AS spos,
                any_value(sr) FILTER (WHERE is_label) AS srpos, any_value(sb) FILTER (WHERE is_label) AS sbpos
         FROM sc GROUP BY b, qi),
qm AS (SELECT sc.b, sc.qi, 1 + sum(CASE WHEN sc.s > p.spos THEN 1 ELSE 0 END) AS rank,
              ln(sum(exp(sc.s - p.mx))) + p.mx - p.spos AS ce, ln(sum(exp(sc.sr - p.mxr))) + p.mxr - p.srpos AS ce_r,
              sum(CASE WHEN sc.is_label THEN 0.0 ELSE greatest(0.0, 0.1::DOUBLE - (p.sbpos - sc.sb)) END) AS hinge_sum,
              sum(CASE WHEN sc.is_label THEN 0 ELSE 1 END) AS hinge_n
       FROM sc JOIN perq p ON p.b = sc.b AND p.qi = sc.qi GROUP BY sc.b, sc.qi, p.mx, p.mxr, p.spos, p.srpos, p.sbpos),
bm AS (SELECT b, count(*) AS nq, sum(rank) AS rank_sum, avg(ce) AS dpr, sum(hinge_sum) / sum(hinge_n) AS cand,
              avg(ce_r) AS rer FROM qm GROUP BY b)
SELECT round(sum(rank_sum) / sum(nq), 6) AS avg_rank, round(avg(dpr), 6) AS dpr_loss, round(avg(cand), 6) AS cand_loss,
       round(avg(rer), 6) AS rerank_loss, round(avg(cand + rer), 6) AS total_loss, count(*)::BIGINT AS n_batches
FROM bm"""

SQL["p9_before_rank_epoch"] = SQL["p9_biencoder_eval"].replace("round(sum(rank_sum) / sum(nq), 6) AS avg_rank", "10000000.0::DOUBLE AS avg_rank")

SQL["k1_question_stream"] = p6_sql("""(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS qid, text AS question, []::VARCHAR[] AS answers
   FROM conversations WHERE role = 'user')""")

SQL["c5_corpus_answer_search"] = f"""
WITH a AS (SELECT qid, unnest(answers) AS answer, generate_subscripts(answers, 1) - 1 AS idx FROM (
             SELECT qid, answers || CASE WHEN qid % 10 = 0 THEN [' '] ELSE [] END AS answers FROM {QUESTIONS})),
atk AS (SELECT qid, idx, {tokens(nfd('answer'))} AS atoks FROM a),
pt AS (SELECT doc_id AS id, {joined(tokens(nfd('text')))} AS pj FROM documents)
SELECT atk.qid, atk.idx::BIGINT AS idx, pt.id FROM atk, pt WHERE len(atk.atoks) > 0 AND contains(pt.pj, {joined('atk.atoks')})
UNION ALL SELECT qid, idx::BIGINT, NULL FROM atk WHERE len(atoks) = 0"""

SQL["j4_dense_text_retrieval"] = f"""
WITH qs AS {QUESTIONS}, ps AS {PASSAGES},
qv AS {encoded("(SELECT qid, rtrim(question, '?') AS qtext FROM qs)", "qid", "qtext")},
pv AS {encoded("(SELECT id, concat_ws(' ', title, text) AS ptext FROM ps)", "id", "ptext")},
r AS (SELECT q.qid, p.id, {ip('q.embedding', 'p.embedding')} AS score,
             row_number() OVER (PARTITION BY q.qid ORDER BY {ip('q.embedding', 'p.embedding')} DESC, p.id) AS rank
      FROM qv q, pv p)
SELECT qid, rank::BIGINT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 20"""

SQL["p2_passage_codes"] = f"""
WITH ps AS {PASSAGES},
pv AS {encoded("(SELECT id, concat_ws(' ', title, text) AS ptext FROM ps)", "id", "ptext")}
SELECT id, array_to_string({pack('embedding')}, ',') AS code FROM pv"""
