"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from oracle import sql as o
from ravel.sources.fixtures import duckdb_ctes

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, *fixtures: str) -> None:
    ORACLE[name] = duckdb_ctes(*fixtures) + sql if fixtures else sql


def _with(fixtures: tuple[str, ...], extra: str) -> str:
    """Fixture CTEs followed by more CTEs (``extra`` starts without WITH)."""
    head = duckdb_ctes(*fixtures)
    return head + ", " + extra if head else "WITH " + extra


ORACLE["usable_topic_problems"] = _with(("reasoning",), f"""
ok AS (SELECT * FROM reasoning
       WHERE NOT {o.low_quality('problem', 'think', 'response')} AND {o.steps('response')} AND {o.topic('problem')}),
ranked AS (SELECT src, row_number() OVER (PARTITION BY {o.key('problem')} ORDER BY id) AS rn FROM ok)
SELECT src, count(*) AS n_problems FROM ranked WHERE rn = 1 GROUP BY src
""")


from ravel.params import BOXED_INSTRUCTION, EQUIVALENCE_PROMPT, MASK_WORDS, SYSTEM_PROMPT, TOPIC_SYSTEM_PROMPT  # noqa: E402

Q = o.q
BX = "bx AS MATERIALIZED (SELECT completion_id, problem, solution, content, " + o.extract_boxed("content") + " AS boxed FROM completions)"


def C(*fx: str):
    return lambda extra: _with(fx, extra)


# ---- 2.9 scalars ----
ORACLE["extract_boxed"] = _with(("completions",), BX + " SELECT completion_id, boxed FROM bx")
ORACLE["after_equals"] = _with(("completions",), BX + f" SELECT completion_id, {o.after_equals('boxed')} AS value FROM bx")
ORACLE["normalize_text_cmd"] = _with(("completions",), BX + f" SELECT completion_id, {o.text_cmd('boxed')} AS value FROM bx")
ORACLE["normalize_dne"] = _with(("completions",), BX + f" SELECT completion_id, {o.dne('boxed')} AS value FROM bx")
ORACLE["choice_letter"] = _with(("completions",), BX + f" SELECT completion_id, {o.choice_letter('boxed')} AS letter FROM bx")
ORACLE["choice_value"] = _with(("completions",), BX + f", l AS (SELECT *, {o.choice_letter('boxed')} AS letter FROM bx) "
                               f"SELECT completion_id, {o.choice_value('letter', 'problem')} AS value FROM l")
ORACLE["grade"] = _with(("completions",), BX + "," + o.grade_ctes("bx", "problem", "boxed", "solution", False)
                        + " SELECT completion_id, is_correct FROM g5")
ORACLE["normalize_gold"] = duckdb_ctes("reasoning") + f"SELECT id, {o.normalize_gold('response')} AS gold FROM reasoning"
_FB = r"\\boxed\{(.*?)\}"
ORACLE["extract_answer_fallback"] = duckdb_ctes("completions") + (
    f"SELECT completion_id, CASE WHEN regexp_matches(content, {Q(_FB)}) THEN {o.strip(f'regexp_extract(content, {Q(_FB)}, 1)')} "
    f"WHEN len(regexp_extract_all(content, {Q(o.D + '+')})) > 0 THEN regexp_extract_all(content, {Q(o.D + '+')})[-1] "
    f"ELSE {Q('Không tìm thấy')} END AS answer FROM completions")
ORACLE["parse_verdict"] = duckdb_ctes("verdicts") + f"SELECT id, {o.parse_verdict('verdict_text')} AS verdict FROM verdicts"
ORACLE["parse_topic_verdict"] = duckdb_ctes("verdicts") + f"SELECT id, contains(upper({o.strip('verdict_text')}), 'TRUE') AS is_topic FROM verdicts"
ORACLE["rewrite_steps"] = duckdb_ctes("reasoning") + f"SELECT id, {o.rewrite_steps('response')} AS response FROM reasoning"
_BOXPAT = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
_INNER = f"regexp_extract(b, {Q(r'(?s)^\\boxed\{(.*)\}$')}, 1)"
_LET = f"regexp_extract({_INNER}, {Q('(?i)([A-D])(' + o.WS + '|[.),:;]|$)')}, 1)"
ORACLE["fix_choice_box"] = duckdb_ctes("completions") + (
    f"SELECT completion_id, array_to_string(list_transform(list_zip(string_split_regex(content, {Q(_BOXPAT)}), "
    f"list_concat(list_transform(regexp_extract_all(content, {Q(_BOXPAT)}), lambda b: CASE WHEN {_LET} <> '' "
    f"THEN concat({Q(chr(92) + 'boxed{')}, upper({_LET}), '}}') ELSE b END), [''])), lambda z: concat(z[1], z[2])), '') AS content "
    f"FROM completions")
ORACLE["curated_answer"] = duckdb_ctes("reasoning") + f"SELECT id, {o.extract_boxed(o.strip('response'))} AS answer FROM reasoning"


def _sublist_end(ids: str, sub: list[int]) -> str:
    m = len(sub)
    lit = "[" + ", ".join(map(str, sub)) + "]"
    return (f"coalesce(list_filter(range(1, len({ids}) - {m} + 2), lambda i: {ids}[i:i + {m - 1}] = {lit})[1] - 1 + {m}, -1)")


ORACLE["find_sublist_end"] = duckdb_ctes("token_rows") + (
    f"SELECT id, {_sublist_end('input_ids', [3, 4])} AS end_pos, {_sublist_end('input_ids', [1001])} AS think_end FROM token_rows")
ORACLE["generated_token_count"] = duckdb_ctes("token_rows") + (
    "SELECT id, coalesce(greatest(0, list_max(list_transform(input_ids, lambda x, i: CASE WHEN x <> 1 THEN i - 1 END)) - 3 + 1), 0) "
    "AS n_generated FROM token_rows")
LAB = ("lab AS (SELECT id, input_ids, CASE WHEN coalesce(list_position(input_ids, 1000), 0) > 0 THEN "
       "CAST(list_transform(input_ids, lambda x, i: CASE WHEN i <= list_position(input_ids, 1000) THEN -100 ELSE x END) AS INTEGER[]) "
       "END AS labels FROM token_rows)")
ORACLE["sft_examples"] = _with(("token_rows",), LAB + " SELECT id, input_ids, labels FROM lab")
SEQS = [[len(w)] if w not in ("Let", "Now") else [3, len(w) + 1] for w in MASK_WORDS]


def _step_mask(src: str) -> str:
    """CTEs up to ``sm`` (id, input_ids, labels): numbers between a step prefix [3, 4] and the next 2 are masked but for one."""
    return f"""
sp0 AS (SELECT id, input_ids, labels, list_filter(range(0, len(input_ids) - 1), lambda k: input_ids[k + 1] = 3 AND input_ids[k + 2] = 4) AS ps,
   list_filter(range(0, len(input_ids)), lambda k: input_ids[k + 1] = 2) AS cs FROM {src}),
sp1 AS (SELECT id, a, c, 1 AS j FROM (SELECT id, list_filter(ps, lambda p: p >= 0)[1] + 2 AS a, cs FROM sp0) x,
   LATERAL (SELECT list_filter(x.cs, lambda k: k >= x.a)[1] AS c) WHERE a IS NOT NULL AND c IS NOT NULL
 UNION ALL SELECT y.id, y.a, z.c, y.j FROM (SELECT sp1.id, list_filter(sp0.ps, lambda p: p >= sp1.c)[1] + 2 AS a, sp0.cs, sp1.j + 1 AS j
   FROM sp1 JOIN sp0 ON sp0.id = sp1.id) y, LATERAL (SELECT list_filter(y.cs, lambda k: k >= y.a)[1] AS c) z WHERE y.a IS NOT NULL AND z.c IS NOT NULL),
sp2 AS (SELECT id, count(*) AS n FROM sp1 GROUP BY id),
sp3 AS (SELECT sp1.id, list([a, c]) AS m FROM sp1 JOIN sp2 ON sp2.id = sp1.id
   WHERE sp1.j - 1 <> CAST(floor({o.md5_unit("'42'", "sp1.id || ':step'")} * sp2.n) AS BIGINT) GROUP BY sp1.id),
sm0 AS (SELECT sp0.id, unnest(range(0, len(labels))) AS k, unnest(labels) AS l FROM sp0),
smk AS (SELECT id, unnest(range(s[1], s[2])) AS k FROM (SELECT id, unnest(m) AS s FROM sp3)),
sm1 AS (SELECT sm0.id, list(CASE WHEN smk.k IS NOT NULL THEN -100 ELSE l END ORDER BY sm0.k) AS labels
   FROM sm0 LEFT JOIN smk ON smk.id = sm0.id AND smk.k = sm0.k GROUP BY sm0.id),
sm AS (SELECT sp0.id, sp0.input_ids, CAST(coalesce(sm1.labels, []) AS INTEGER[]) AS labels FROM sp0 LEFT JOIN sm1 ON sm1.id = sp0.id)"""


def _word_mask(src: str, seqs: list[list[int]], ratio: float) -> str:
    """CTEs up to ``wm`` (id, labels): a share of the greedy left-to-right matches is masked."""
    def at(seq: list[int]) -> str:
        return "(" + " AND ".join(f"input_ids[k + {i + 1}] = {x}" for i, x in enumerate(seq)) + ")"

    size = "CASE " + " ".join(f"WHEN {at(q_)} THEN {len(q_)}" for q_ in seqs) + " ELSE 0 END"
    return f"""
wh AS (SELECT id, list_filter(list_transform(range(0, len(input_ids)), lambda k: {{'k': k, 'l': {size}}}), lambda h: h.l > 0) AS h FROM {src}),
ws AS (SELECT id, list_reduce(h, lambda acc, x: CASE WHEN x.k >= acc.free THEN {{'free': x.k + x.l, 's': list_append(acc.s, {{'k': x.k, 'l': x.l}})}} ELSE acc END,
   {{'free': CAST(0 AS BIGINT), 's': CAST([] AS STRUCT(k BIGINT, l INTEGER)[])}}).s AS s FROM
   (SELECT id, list_transform(h, lambda x: {{'free': CAST(0 AS BIGINT), 's': CAST([] AS STRUCT(k BIGINT, l INTEGER)[]), 'k': x.k, 'l': x.l}}) AS h FROM wh)),
wr AS (SELECT id, i, s[i + 1] AS x, len(s) AS n FROM (SELECT id, s, unnest(range(0, len(s))) AS i FROM ws)),
wc AS (SELECT id, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', '42', CAST(id AS VARCHAR), CAST(i AS VARCHAR)))) AS rn FROM wr)
   WHERE rn <= floor(n * CAST({ratio} AS DOUBLE))),
wk AS (SELECT id, unnest(range(x.k, x.k + x.l)) AS k FROM wc),
wl AS (SELECT id, unnest(range(0, len(labels))) AS k, unnest(labels) AS l FROM {src}),
wm1 AS (SELECT wl.id, list(CASE WHEN wk.k IS NOT NULL THEN -100 ELSE l END ORDER BY wl.k) AS labels FROM wl LEFT JOIN wk ON wk.id = wl.id AND wk.k = wl.k GROUP BY wl.id),
wm AS (SELECT s.id, CAST(coalesce(wm1.labels, []) AS INTEGER[]) AS labels FROM {src} s LEFT JOIN wm1 ON wm1.id = s.id)"""


ORACLE["mask_step_numbers"] = _with(("token_rows",), LAB + "," + _step_mask("lab") + " SELECT id, labels FROM sm").replace("WITH ", "WITH RECURSIVE ", 1)
# for these two, word lengths are the token rows
ORACLE["mask_marker_words"] = _with(("length_rows",), LAB + "," + _word_mask("lab", SEQS, 0.3) + " SELECT id, labels FROM wm").replace("length_rows AS", "token_rows AS", 1)
ORACLE["prepare_sft"] = _with(("length_rows",), LAB + "," + _step_mask("lab") + "," + _word_mask("sm", SEQS, 0.3)
                              + " SELECT id, labels FROM wm").replace("length_rows AS", "token_rows AS", 1).replace("WITH ", "WITH RECURSIVE ", 1)
WTS = ("wt AS (SELECT id, labels, list_position(list_transform(labels, lambda x: x <> -100), true) - 1 AS s0, "
       "list_position(labels, 1001) - 1 AS e0 FROM lab)")
_W = ("list_transform(labels, lambda x, i: round(CASE WHEN s0 IS NULL OR e0 IS NULL THEN 0.3 WHEN i - 1 >= e0 THEN 0.3 "
      "WHEN i - 1 >= s0 AND i - 1 < e0 THEN (CASE WHEN e0 - s0 > 1 THEN 1.0 - cos(pi() / 2 * (i - 1 - s0) / (e0 - s0 - 1)) ELSE 1.0 END) "
      "ELSE 0.0 END, 9))")
ORACLE["token_weights"] = _with(("token_rows",), LAB + ", " + WTS + f" SELECT id, {_W} AS weights FROM wt")
ORACLE["pad_batches"] = _with(("token_rows",), LAB + """,
b AS (SELECT *, CAST(floor(id / 8) AS BIGINT) AS batch_id FROM lab),
m AS (SELECT batch_id, CAST(ceil(max(len(input_ids)) / 8) * 8 AS INTEGER) AS target FROM b GROUP BY batch_id)
SELECT id,
  CAST(list_concat(list_transform(range(greatest(target - len(input_ids), 0)), lambda x: 0), input_ids) AS INTEGER[]) AS input_ids,
  CAST(list_concat(list_transform(range(greatest(target - len(labels), 0)), lambda x: -100), labels) AS INTEGER[]) AS labels,
  CAST(list_concat(list_transform(range(greatest(target - len(input_ids), 0)), lambda x: 0), list_transform(input_ids, lambda x: 1)) AS INTEGER[]) AS attention_mask
FROM b JOIN m USING (batch_id)""")

# ---- 2.2 projections ----
ORACLE["map_source_columns"] = duckdb_ctes("reasoning") + (
    f"SELECT id, {o.strip('problem')} AS problem, {o.strip('response')} AS response, 'math' AS data_type, src AS source, "
    "true AS boxed_force FROM reasoning")
ORACLE["first_if_list"] = "SELECT conv_id, turn, string_split(text, chr(10))[1] AS first FROM conversations"
ORACLE["split_think_answer"] = duckdb_ctes("completions") + (
    f"SELECT completion_id, CASE WHEN contains(content, '</think>') THEN {o.strip(chr(115) + 'plit_part(content, ' + Q('</think>') + ', 1)')} END AS think, "
    f"CASE WHEN contains(content, '</think>') THEN {o.strip('substr(content, strpos(content, ' + Q('</think>') + ') + 8)')} END AS answer "
    "FROM completions")
_LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
ORACLE["box_answer_signal"] = _with(("reasoning",), f"""
s AS (SELECT id, {o.strip('response')} AS t FROM reasoning),
l AS (SELECT id, t, string_split_regex(t, {Q(_LB)}) AS lines FROM s)
SELECT id, CASE WHEN t = '' THEN NULL ELSE array_to_string(list_concat(lines[1:len(lines) - 1],
  [CASE WHEN starts_with(lines[-1], 'So ') THEN concat({Q('The answer is: ' + chr(92) + 'boxed{')}, {o.strip("replace(lines[-1], 'So ', '')")}, '}}')
   ELSE lines[-1] END]), chr(10)) END AS answer FROM l""")
ORACLE["strip_outer_tags"] = duckdb_ctes("completions") + (
    f"SELECT completion_id, {o.strip_outer_tags('split_part(content, ' + Q('</think>') + ', 1)')} AS think FROM completions")
_TAGS = "content"
for _t in ("think", "answer"):
    _TAGS = f"regexp_replace({_TAGS}, {Q('</?' + _t + '(>|' + o.NW[:-1] + '>][^>]*>)')}, '', 'gi')"
ORACLE["strip_named_tags"] = duckdb_ctes("completions") + f"SELECT completion_id, {_TAGS} AS content FROM completions"
ORACLE["bucket_difficulty"] = duckdb_ctes("reasoning") + (
    f"SELECT id, CASE WHEN {o.approx_tokens('think')} < 700 THEN 'easy' WHEN {o.approx_tokens('think')} < 1400 THEN 'medium' "
    "ELSE 'hard' END AS difficulty FROM reasoning")
ORACLE["think_length"] = duckdb_ctes("reasoning") + f"SELECT id, {o.think_len('think')} AS think_len FROM reasoning"
_SYS = f"{{'role': 'system', 'content': {Q(SYSTEM_PROMPT + BOXED_INSTRUCTION)}}}"
_ASST = ("concat(CASE WHEN think IS NOT NULL THEN concat('<think>', chr(10), think, chr(10), '</think>', chr(10)) ELSE '' END, "
         "CASE WHEN think IS NULL AND response IS NOT NULL THEN concat('<think>', chr(10), chr(10), '</think>', chr(10)) ELSE '' END, "
         "coalesce(response, ''))")
_MSGS = (f"list_filter([{_SYS}, {{'role': 'user', 'content': problem}}, "
         f"CASE WHEN {_ASST} <> '' THEN {{'role': 'assistant', 'content': {_ASST}}} END], lambda m: m IS NOT NULL)")
ORACLE["build_messages"] = duckdb_ctes("reasoning") + f"SELECT id, {_MSGS} AS messages FROM reasoning"
ORACLE["render_chat"] = duckdb_ctes("reasoning") + (
    f"SELECT id, array_to_string(list_transform({_MSGS}, lambda m: concat('<|im_start|>', m.role, chr(10), m.content, '<|im_end|>', chr(10))), '') "
    "AS text FROM reasoning")
ORACLE["rl_examples"] = duckdb_ctes("reasoning") + (
    f"SELECT id, [{_SYS}, {{'role': 'user', 'content': problem}}] AS prompt, answer AS solution FROM reasoning")
ORACLE["topic_prompts"] = duckdb_ctes("reasoning") + (
    f"SELECT id, [{{'role': 'system', 'content': {Q(TOPIC_SYSTEM_PROMPT)}}}, {{'role': 'user', 'content': "
    f"replace({Q('Classify this problem:' + chr(10) + chr(10) + '{problem}')}, '{{problem}}', problem)}}] AS messages FROM reasoning")
ORACLE["fill_equivalence_prompt"] = duckdb_ctes("answer_pairs") + (
    f"SELECT id, replace(replace(replace({Q(EQUIVALENCE_PROMPT)}, {Q(chr(34) * 2 + '{instruction}' + chr(34) * 2)}, coalesce(instruction, '')), "
    f"{Q(chr(34) * 2 + '{ans1}' + chr(34) * 2)}, coalesce(ans1, '')), {Q(chr(34) * 2 + '{ans2}' + chr(34) * 2)}, coalesce(ans2, '')) AS prompt "
    "FROM answer_pairs")
ORACLE["drop_columns"] = duckdb_ctes("reasoning") + "SELECT id, prompt_id, src, lang, problem, think, response, answer FROM reasoning"

# ---- 2.3 filters ----
_R = duckdb_ctes("reasoning")
ORACLE["filter_nonempty_question"] = _R + "SELECT id FROM reasoning WHERE problem IS NOT NULL AND problem <> ''"
ORACLE["filter_any_key_equals"] = _R + "SELECT id FROM reasoning WHERE lang IS NOT DISTINCT FROM 'de' OR src IS NOT DISTINCT FROM 'src3'"
ORACLE["filter_correct"] = _R + "SELECT id FROM reasoning WHERE coalesce(grade = 'Yes', false)"
ORACLE["topic_filter"] = _R + f"SELECT id FROM reasoning WHERE {o.topic('problem')}"
ORACLE["classify_topic"] = duckdb_ctes("reasoning", "verdicts") + (
    f"SELECT r.id, ({o.topic('r.problem')} OR coalesce(v.is_topic, false)) AS is_topic FROM reasoning r LEFT JOIN verdicts v ON v.id = r.id")
ORACLE["filter_has_boxed"] = _R + f"SELECT id FROM reasoning WHERE contains(coalesce(response, ''), {Q(chr(92) + 'boxed')})"
ORACLE["filter_low_quality"] = _R + f"SELECT id FROM reasoning WHERE NOT {o.low_quality('problem', 'think', 'response')}"
ORACLE["filter_step_by_step"] = _R + f"SELECT id FROM reasoning WHERE {o.steps('response')}"
_MARK = " OR ".join(f"contains(lower(think), {Q(m)})" for m in ("step", "→", "=>", "first", "therefore", "so", "then", "hence"))
ORACLE["filter_good_thinking"] = _R + (
    f"SELECT id FROM reasoning WHERE (think IS NULL OR (len(list_filter(string_split(think, chr(10) || chr(10)), "
    f"lambda s: length({o.strip('s')}) > 2000)) = 0 AND ({_MARK}))) AND NOT contains(coalesce(response, ''), {Q(chr(92) + 'begin{')})")
ORACLE["filter_token_range"] = _R + (
    f"SELECT id, tok FROM (SELECT id, {o.approx_tokens('think')} AS tok FROM reasoning) WHERE tok >= 100 AND tok <= 800")

# ---- 2.4 joins / 2.10 sets ----
ORACLE["join_predictions"] = duckdb_ctes("completions") + (
    "SELECT r.id AS sample_id, r.answer, length(c.content) AS output_len FROM reasoning r JOIN completions c ON c.completion_id = r.id")
ORACLE["join_solutions"] = _with(("completions",), """sol AS (SELECT prompt_id, min(answer) AS solution FROM reasoning GROUP BY prompt_id)
SELECT c.completion_id, c.prompt_id, s.solution FROM completions c JOIN sol s ON s.prompt_id = c.prompt_id""")
ORACLE["join_verdicts"] = duckdb_ctes("reasoning", "verdicts") + (
    f"SELECT r.id, {o.parse_verdict('v.verdict_text')} AS verdict FROM reasoning r LEFT JOIN verdicts v ON v.id = r.id")
ORACLE["except_holdout"] = duckdb_ctes("reasoning", "verdicts") + "SELECT id, prompt_id FROM reasoning WHERE id NOT IN (SELECT id FROM verdicts)"
ORACLE["union_sources"] = duckdb_ctes("completions") + (
    "SELECT id AS row_id, 'reasoning' AS source, NULL AS answer, length(problem) AS problem_len FROM reasoning "
    "UNION ALL SELECT completion_id, 'completions', solution, length(problem) FROM completions")

# ---- 2.5 aggregations ----
DETAILS = ("d0 AS MATERIALIZED (SELECT r.id AS sample_id, r.problem, r.lang, c.token_generated, "
           f"{o.normalize_gold('r.answer')} AS gold, {o.extract_boxed('c.content')} AS pred, {o.strip('c.content')} AS raw_output "
           "FROM reasoning r JOIN completions c ON c.completion_id = r.id)," + o.grade_ctes("d0", "problem", "pred", "gold", False))
ORACLE["eval_accuracy"] = _with(("completions",), DETAILS + """
SELECT lang, sum(CAST(is_correct AS BIGINT)) AS correct, count(*) AS total,
  coalesce(sum(CAST(is_correct AS BIGINT)) / count(*) * 100.0, 0.0) AS accuracy,
  coalesce(sum(token_generated) / count(*), 0.0) AS avg_tokens FROM g5 GROUP BY lang""")
DECISIONS = (f"dec AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {o.key('coalesce(problem, ' + Q('') + ')')} ORDER BY id) > 1 "
             f"THEN 'duplicate' WHEN NOT contains(coalesce(response, ''), {Q(chr(92) + 'boxed')}) THEN 'no_boxed' "
             f"WHEN {o.topic('problem')} THEN 'topic' ELSE 'other' END AS decision FROM reasoning)")
ORACLE["curation_counts"] = _with(("reasoning",), DECISIONS + " SELECT decision, count(*) AS n FROM dec GROUP BY decision")
_WC = {w: o.count_word("content", w) for w in ("Wait", "Alternatively", "But")}
ORACLE["count_marker_words"] = duckdb_ctes("completions") + (
    "SELECT " + ", ".join(f"coalesce(sum({e}), 0) AS {w}" for w, e in _WC.items())
    + f", coalesce(sum({' + '.join(_WC.values())}), 0) AS total FROM completions")
ORACLE["verdict_counts"] = duckdb_ctes("verdicts") + (
    f"SELECT count(*) FILTER (WHERE v = true) AS n_true, count(*) FILTER (WHERE v = false) AS n_false, "
    f"count(*) FILTER (WHERE v IS NULL) AS n_unparsed FROM (SELECT {o.parse_verdict('verdict_text')} AS v FROM verdicts)")
TL = f"t AS (SELECT id, {o.think_len('think')} AS tl FROM reasoning)"
ORACLE["length_profile"] = _with(("reasoning",), TL + """
SELECT count(*) AS n, min(tl) AS min_len, max(tl) AS max_len, round(avg(tl), 9) AS mean_len,
  CAST(quantile_cont(tl, 0.5) AS DOUBLE) AS median_len, round(stddev_pop(tl), 6) AS std_len FROM t""")
ORACLE["length_histogram"] = _with(("reasoning",), TL + "," + o.histogram("t", "tl", 50) + " " + o.histogram_select().replace("BINS", "50"))
ORACLE["length_quantile_curve"] = _with(("reasoning",), TL + """,
dist AS (SELECT tl AS v, count(*) AS n FROM t GROUP BY tl),
cum AS (SELECT v, n, sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM dist)
SELECT v AS length, CAST(e - n AS BIGINT) AS first_position, CAST(e - 1 AS BIGINT) AS last_position, n FROM cum""")
ALIGNED = LAB + ", " + WTS + """,
wts AS (SELECT id, labels, list_transform(labels, lambda x, i: CASE WHEN s0 IS NULL OR e0 IS NULL THEN 0.3 WHEN i - 1 >= e0 THEN 0.3
   WHEN i - 1 >= s0 AND i - 1 < e0 THEN (CASE WHEN e0 - s0 > 1 THEN 1.0 - cos(pi() / 2 * (i - 1 - s0) / (e0 - s0 - 1)) ELSE 1.0 END)
   ELSE 0.0 END) AS w FROM wt),
pos AS (SELECT id, labels, w, unnest(range(len(labels))) AS pos FROM wts),
aligned AS (SELECT p.id, p.pos, coalesce(p.labels[p.pos + 2], -100) AS label, p.w[p.pos + 2] AS weight, l.nll, l.neg_logprob_sum
   FROM pos p JOIN token_losses l ON l.id = p.id AND l.pos = p.pos)"""
ORACLE["token_loss_profile"] = _with(("token_rows", "token_losses"), ALIGNED + """
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE nll < 0.15) AS n_below, count(*) FILTER (WHERE nll >= 0.15) AS n_at_or_above,
  min(nll) AS min_loss, max(nll) AS max_loss, round(avg(nll), 9) AS mean_loss FROM aligned WHERE label <> -100""")
ORACLE["token_loss_histogram"] = _with(("token_rows", "token_losses"), ALIGNED + ", v AS (SELECT nll FROM aligned WHERE label <> -100),"
                                       + o.histogram("v", "nll", 1000) + " " + o.histogram_select(True).replace("BINS", "1000"))
ORACLE["weighted_token_loss"] = _with(("token_rows", "token_losses"), ALIGNED + """,
act AS (SELECT id, (label <> -100 AND nll >= 0.1) AS a, nll, neg_logprob_sum AS s, coalesce(weight, 1.0) AS w FROM aligned),
g AS (SELECT id, count(*) FILTER (WHERE a) AS n, sum(CASE WHEN a THEN nll * w ELSE 0.0 END) AS sn,
        sum(CASE WHEN a THEN s * w ELSE 0.0 END) AS ss FROM act GROUP BY id)
SELECT id, n AS n_active, round(CASE WHEN n = 0 THEN 0.0 ELSE ((0.9 * sn) / n + (0.1 * ss) / (n * 10.0)) / 1.0 END, 9) AS loss FROM g""")
ORACLE["length_sketch"] = "SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS quantile, true AS within"
ORACLE["distinct_problem_sketch"] = _R + (
    f"SELECT src, count(DISTINCT {o.key('problem')}) AS n_unique, true AS within FROM reasoning GROUP BY src "
    f"UNION ALL SELECT 'all', count(DISTINCT {o.key('problem')}), true FROM reasoning")
ORACLE["distinct_problems"] = _R + f"SELECT count(DISTINCT {o.key('problem')}) AS n_unique FROM reasoning"

# ---- 2.6 windows / 2.7 ordering ----
ORACLE["dedup_keep_first"] = _R + (
    f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {o.key('problem')} ORDER BY id) AS rn FROM reasoning) WHERE rn = 1")
ORACLE["cap_per_group"] = _R + (
    "SELECT id, src FROM (SELECT id, src, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws(':', '3407', CAST(id AS VARCHAR))), id) "
    "AS rn FROM reasoning) WHERE rn <= 10")
ORACLE["running_accuracy"] = _with(("completions",), DETAILS + """,
b AS (SELECT lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY sample_id) - 1) / 10) AS BIGINT) AS batch, is_correct FROM g5),
s AS (SELECT lang, batch, sum(CAST(is_correct AS BIGINT)) AS c, count(*) AS n FROM b GROUP BY lang, batch)
SELECT lang, batch, sum(c) OVER w AS correct_so_far, sum(n) OVER w AS seen_so_far, round(sum(c) OVER w / sum(n) OVER w * 100.0, 9) AS accuracy_so_far
FROM s WINDOW w AS (PARTITION BY lang ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
CORRECT = ("cc0 AS MATERIALIZED (SELECT completion_id, prompt_id, content, solution, " + o.extract_boxed("content") + " AS boxed FROM completions),"
           + o.grade_ctes("cc0", "content", "boxed", "solution", True, out="k"))
ORACLE["reward_length"] = _with(("completions",), CORRECT + """,
e AS (SELECT prompt_id, min(length(content)) AS mn, max(length(content)) AS mx FROM k5 GROUP BY prompt_id)
SELECT completion_id, round(CASE WHEN mx = mn THEN 0.0
   WHEN is_correct THEN 0.5 - CAST(length(content) - mn AS DOUBLE) / (mx - mn)
   ELSE least(0.0, 0.5 - CAST(length(content) - mn AS DOUBLE) / (mx - mn)) END, 9) AS reward
FROM k5 JOIN e USING (prompt_id)""")
ORACLE["length_reward"] = ORACLE["reward_length"]
UNIQ = f"""u AS (SELECT * FROM (SELECT id, {o.think_len('think')} AS think_len,
      row_number() OVER (PARTITION BY {o.key('problem')} ORDER BY {o.think_len('think')}, id) AS rn FROM reasoning) WHERE rn = 1),
rk AS (SELECT id, think_len, CAST(row_number() OVER (ORDER BY think_len, id) - 1 AS BIGINT) AS rank FROM u),
sz AS (SELECT count(*) AS nu, CAST(floor(count(*) * (CAST(0.017 AS DOUBLE) + CAST(0.032 AS DOUBLE))) AS BIGINT) AS k FROM u),
grid AS (SELECT CAST(g.range AS BIGINT) AS i, CAST(floor(CAST(g.range AS DOUBLE) * (CAST(sz.nu AS DOUBLE) / sz.k)) AS BIGINT) AS p
         FROM sz, range(sz.k) g)"""
ORACLE["even_spaced_rank"] = _with(("reasoning",), UNIQ + " SELECT rk.id, rk.think_len, rk.rank, grid.i AS grid_index FROM rk LEFT JOIN grid ON grid.p = rk.rank")
ORACLE["split_train_val_test"] = _with(("reasoning",), UNIQ + """,
nv AS (SELECT k, CAST(floor(k * (CAST(0.017 AS DOUBLE) / (CAST(0.017 AS DOUBLE) + CAST(0.032 AS DOUBLE)))) AS BIGINT) AS nval FROM sz),
vgrid AS (SELECT CAST(floor(CAST(g.range AS DOUBLE) * (CAST(nv.k AS DOUBLE) / nv.nval)) AS BIGINT) AS i FROM nv, range(nv.nval) g)
SELECT rk.id, CASE WHEN grid.i IS NULL THEN 'train' WHEN vgrid.i IS NOT NULL THEN 'val' ELSE 'test' END AS split
FROM rk LEFT JOIN grid ON grid.p = rk.rank LEFT JOIN vgrid ON vgrid.i = grid.i""")
_HELD = UNIQ + f", held AS (SELECT {o.key('r.problem')} AS k FROM reasoning r JOIN rk ON rk.id = r.id JOIN grid ON grid.p = rk.rank) "
ORACLE["semijoin_holdout"] = _with(("reasoning",), _HELD + f"SELECT id FROM reasoning WHERE {o.key('problem')} IN (SELECT k FROM held)")
ORACLE["antijoin_holdout"] = _with(("reasoning",), _HELD + f"SELECT id FROM reasoning WHERE {o.key('problem')} NOT IN (SELECT k FROM held)")
ORACLE["leakage"] = _with(("reasoning",), _HELD + f"SELECT r.id FROM reasoning r JOIN rk ON rk.id = r.id LEFT JOIN grid ON grid.p = rk.rank "
                          f"WHERE grid.i IS NULL AND {o.key('r.problem')} IN (SELECT k FROM held)")
ORACLE["take_n"] = _R + "SELECT id FROM reasoning ORDER BY id LIMIT 100"
ORACLE["seeded_shuffle"] = _R + "SELECT id, md5(concat_ws(':', '3407', CAST(id AS VARCHAR))) AS shuffle_key FROM reasoning"
ORACLE["sample_first_accepted"] = _R + (
    f"SELECT id FROM reasoning WHERE {o.steps('response')} ORDER BY md5(concat_ws(':', '3407', CAST(id AS VARCHAR))), id LIMIT 50")
ORACLE["sample_by_length"] = _R + f"""SELECT id FROM (SELECT id, {o.think_len('think')} AS tl,
   greatest({o.md5_unit("'3407'", 'id')}, 1e-300) AS u FROM reasoning)
ORDER BY CASE WHEN pow(CAST(tl AS DOUBLE), 0.7) > 0 THEN -ln(u) / pow(CAST(tl AS DOUBLE), 0.7) ELSE 'inf'::DOUBLE END, id LIMIT 50"""
ORACLE["sort_by_difficulty"] = _R + f"SELECT id, {o.think_len('think')} AS think_len FROM reasoning ORDER BY think_len, id"
ORACLE["best_checkpoint"] = duckdb_ctes("metrics_log") + """SELECT run_id, checkpoint, accuracy FROM (
  SELECT run_id, accuracy, 'best_model_step_' || CAST(step AS VARCHAR) AS checkpoint,
    row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, 'best_model_step_' || CAST(step AS VARCHAR) ASC) AS rn
  FROM metrics_log) WHERE rn = 1"""
ORACLE["best_step"] = duckdb_ctes("metrics_log") + """SELECT run_id, step, accuracy, avg_tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, avg_tokens ASC, step ASC) AS rn
  FROM metrics_log WHERE step % 5 = 0 AND step <> 0) WHERE rn = 1"""
TOPK = """lg AS (SELECT * FROM metrics_log WHERE reward IS NOT NULL),
tp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY reward DESC, step ASC) AS rd FROM lg),
st AS (SELECT run_id, count(*) AS ntop, min(reward) AS v FROM tp WHERE rd <= 3 GROUP BY run_id),
ab AS (SELECT tp.run_id, count(*) FILTER (WHERE tp.reward > st.v) AS m FROM tp JOIN st USING (run_id) WHERE rd <= 3 GROUP BY tp.run_id),
j AS (SELECT lg.*, st.ntop, st.v, ab.m FROM lg JOIN st USING (run_id) JOIN ab USING (run_id)),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rs FROM j WHERE ntop = 3 AND reward >= v) WHERE rs <= 3),
ties AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rl FROM cand WHERE reward = v) WHERE rl <= 3 - m)
SELECT run_id, step, reward FROM j WHERE ntop < 3
UNION ALL SELECT run_id, step, reward FROM j WHERE ntop = 3 AND reward > v
UNION ALL SELECT run_id, step, reward FROM ties"""
ORACLE["topk_rewards"] = _with(("metrics_log",), TOPK)

# ---- 2.8 rewards ----
_C = ("completions",)
ORACLE["reward_accuracy"] = _with(_C, CORRECT + " SELECT completion_id, round(CAST(is_correct AS DOUBLE), 9) AS reward FROM k5")
ORACLE["reward_format"] = duckdb_ctes(*_C) + (
    f"SELECT completion_id, CASE WHEN {o.count_literal('content', chr(10) + '</think>' + chr(10))} = 1 THEN 1.0 ELSE 0.0 END AS reward FROM completions")
_STEP = rf"(Step {o.D}+:|^{o.D}+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
ORACLE["reward_steps"] = duckdb_ctes(*_C) + (
    f"SELECT completion_id, round(least(1.0, len(regexp_extract_all(coalesce(content, ''), {Q(_STEP)})) / 3.0), 9) AS reward FROM completions")


def _cos_raw(progress: str) -> str:
    lo = "CASE WHEN is_correct THEN 0.5 ELSE -0.5 END"
    hi = "CASE WHEN is_correct THEN 1.0 ELSE 0.0 END"
    return f"(({lo}) + 0.5 * (({hi}) - ({lo})) * (1.0 + cos(({progress}) * pi())))"


def _cos(progress: str) -> str:
    return f"round({_cos_raw(progress)}, 9)"


ORACLE["reward_cosine_length"] = _with(_C, CORRECT + f" SELECT completion_id, {_cos('least(length(content) / 12000.0, 1.0)')} AS reward FROM k5")
_MT = " + ".join(_WC.values())
ORACLE["reward_cosine_markers"] = _with(_C, CORRECT + f" SELECT completion_id, {_cos(f'least(({_MT}) / 15.0, 1.0)')} AS reward FROM k5")
_WORDS = o.split_ws("lower(content)")
REP = f"""rp AS (SELECT completion_id, content, {_WORDS} AS words FROM completions),
rp2 AS (SELECT completion_id, content, words, len(words) - 3 + 1 AS total,
   len(list_distinct(list_transform(range(1, greatest(len(words) - 3 + 1, 1) + 1), lambda i: array_to_string(words[i:i + 2], ' ')))) AS d FROM rp),
rep AS (SELECT completion_id, CASE WHEN content = '' THEN 0.0 WHEN len({o.split_ws('content')}) < 3 THEN 0.0
   ELSE (1.0 - CAST(d AS DOUBLE) / total) * -0.5 + 0.0 END AS r FROM rp2)"""
ORACLE["reward_repetition"] = _with(_C, REP + " SELECT completion_id, round(r, 9) AS reward FROM rep")
_HDR = f"regexp_extract(coalesce(content, ''), {Q('(?s)<think>' + chr(10) + '?(.*?)' + chr(10) + chr(10))}, 1)"
ORACLE["reward_formula"] = duckdb_ctes(*_C) + (
    f"SELECT completion_id, CASE WHEN regexp_matches({_HDR}, {Q('(?m)^- formula ' + o.D + '+:')}) THEN 1.0 ELSE 0.0 END AS reward FROM completions")
_LATEX = r"(?s)\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{.*?\}.*?\\end\{.*?\}"
_LCMD = r"\\[a-zA-Z]+(?:\{[^{}]*\}|\[[^\[\]]*\])*"
_NL = o.flagged_class()
ORACLE["flag_script"] = duckdb_ctes(*_C) + (
    f"SELECT completion_id, CASE WHEN regexp_matches(regexp_replace(regexp_replace(coalesce(content, ''), {Q(_LATEX)}, '', 'g'), {Q(_LCMD)}, '', 'g'), "
    f"{Q(_NL)}) THEN 0.0 ELSE 1.0 END AS reward FROM completions")
ORACLE["reward_total"] = _with(_C, CORRECT + ", " + REP + f""",
parts AS (SELECT k5.completion_id,
   CASE WHEN {o.count_literal('k5.content', chr(10) + '</think>' + chr(10))} = 1 THEN 1.0 ELSE 0.0 END AS fmt,
   {_cos_raw(f'least(({_MT.replace("content", "k5.content")}) / 15.0, 1.0)')} AS cm,
   rep.r AS rp FROM k5 JOIN rep ON rep.completion_id = k5.completion_id)
SELECT completion_id, round(1.0 * fmt + 2.0 * cm + 0.1 * rp, 9) AS reward FROM parts""")


# ---- 2.12 composite jobs ----
_MARKERS = ("step", "→", "=>", "first", "therefore", "so", "then", "hence")


def _good_thinking(th: str, a: str) -> str:
    marks = " OR ".join(f"contains(lower({th}), {Q(m)})" for m in _MARKERS)
    return f"(({th} IS NULL OR ({marks})) AND NOT contains(coalesce({a}, ''), {Q(chr(92) + 'begin{')}))"


def _render(q_: str, th: str, a: str) -> str:
    asst = (f"concat(CASE WHEN {th} IS NOT NULL THEN concat('<think>', chr(10), {th}, chr(10), '</think>', chr(10)) ELSE '' END, "
            f"CASE WHEN {th} IS NULL AND {a} IS NOT NULL THEN concat('<think>', chr(10), chr(10), '</think>', chr(10)) ELSE '' END, "
            f"coalesce({a}, ''))")
    return (f"concat('<|im_start|>system', chr(10), {Q(SYSTEM_PROMPT + BOXED_INSTRUCTION)}, '<|im_end|>', chr(10), "
            f"'<|im_start|>user', chr(10), {q_}, '<|im_end|>', chr(10), "
            f"CASE WHEN {asst} <> '' THEN concat('<|im_start|>assistant', chr(10), {asst}, '<|im_end|>', chr(10)) ELSE '' END)")


def _box_signal(x: str, sig: str) -> str:
    t = o.strip(x)
    lines = f"string_split_regex({t}, {Q(_LB)})"
    new_last = (f"CASE WHEN starts_with({lines}[-1], {Q(sig)}) THEN concat({Q('The answer is: ' + chr(92) + 'boxed{')}, "
                f"{o.strip(f'replace({lines}[-1], {Q(sig)}, {Q(chr(0))[:0]}' + repr('')[1:-1] + chr(39) + chr(39) + ')')}, '}}') ELSE {lines}[-1] END")
    return f"(CASE WHEN {t} = '' THEN NULL ELSE array_to_string(list_concat({lines}[1:len({lines}) - 1], [{new_last}]), chr(10)) END)"


def curate_sql(p: str, src: str, name: str, q_: str, a: str, think: str | None, rid: str, correct: str | None = None,
               split_think: bool = False, signal: str | None = None, group: str | None = None, max_per_group: int = 50,
               n: int | None = None, min_tok: int | None = None, max_tok: int | None = None, seed: str = "3407") -> str:
    """CTEs ``{p}1..{p}6`` mirroring one curation spec; ``{p}_out`` has the curated columns."""
    where = [f"{q_} IS NOT NULL", f"CAST({q_} AS VARCHAR) <> ''"] + ([f"coalesce({correct} = 'Yes', false)"] if correct else [])
    a0 = f"CAST({a} AS VARCHAR)"
    if signal is not None:
        a0 = _box_signal(a0, signal)
    if think is None:
        th0, a1, extra = "CAST(NULL AS VARCHAR)", a0, "true"
    elif split_think:
        t = f"coalesce(CAST({think} AS VARCHAR), '')"
        th0 = f"CASE WHEN contains({t}, '</think>') THEN {o.strip(f'split_part({t}, {Q(chr(60) + '/think>')}, 1)')} END"
        a1 = f"CASE WHEN contains({t}, '</think>') THEN {o.strip(f'substr({t}, strpos({t}, {Q(chr(60) + '/think>')}) + 8)')} END"
        extra = f"contains({t}, '</think>')"
    else:
        th0, a1, extra = f"coalesce(CAST({think} AS VARCHAR), '')", a0, "true"
    th1 = o.strip_outer_tags("_th0") if think is not None else "_th0"
    grp = group if group else "NULL"
    key = f"md5(concat_ws(':', '{seed}', CAST(_rid AS VARCHAR)))"
    tok_rng = " AND ".join([f"_tok >= {min_tok}"] * (min_tok is not None) + [f"_tok <= {max_tok}"] * (max_tok is not None)) or "true"
    capped = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _grp ORDER BY {key}, _rid) AS _gn FROM {p}4) WHERE _gn <= {max_per_group}"
              if group else f"SELECT * FROM {p}4")
    limited = f"SELECT * FROM {p}5 ORDER BY {key}, _rid LIMIT {n}" if n is not None else f"SELECT * FROM {p}5"
    return f"""
{p}1 AS (SELECT {rid} AS _rid, {grp} AS _grp, CAST({q_} AS VARCHAR) AS _q, {a1} AS _a, {th0} AS _th0 FROM {src}
         WHERE {' AND '.join(where)} AND {extra}),
{p}2 AS (SELECT *, {th1} AS _th FROM {p}1 WHERE _a IS NOT NULL),
{p}3 AS (SELECT * FROM {p}2 WHERE {_good_thinking('_th', '_a')} AND {o.steps('_a')} AND NOT {o.low_quality('_q', '_th', '_a')}),
{p}4 AS (SELECT * FROM (SELECT *, {o.approx_tokens(_render('_q', '_th', '_a'))} AS _tok FROM {p}3) WHERE {tok_rng}),
{p}5 AS ({capped}),
{p}6 AS ({limited}),
{p}_out AS (SELECT CAST(_rid AS BIGINT) AS row_id, {o.strip('_q')} AS problem, {o.rewrite_steps(o.strip('_a'))} AS response, 'math' AS data_type,
   CASE WHEN _tok < 700 THEN 'easy' WHEN _tok < 1400 THEN 'medium' ELSE 'hard' END AS difficulty, {Q(name)} AS source,
   {o.extract_boxed(o.strip('_a'))} AS answer, CAST(NULL AS VARCHAR) AS mask,
   {o.strip('_th') if think is not None else 'CAST(NULL AS VARCHAR)'} AS think, true AS boxed_force FROM {p}6)"""


CUR_R = curate_sql("ra", "reasoning", "reasoning", "problem", "response", "think", "id", correct="grade", min_tok=10, max_tok=6000)
CUR_R0 = curate_sql("ra", "reasoning", "reasoning", "problem", "response", "think", "id", correct="grade", min_tok=10)
CUR_C = curate_sql("cb", "completions", "completions", "problem", "content", "content", "completion_id", split_think=True, max_tok=8000)
ORACLE["curate_source"] = _with(("reasoning",), CUR_R + " SELECT * FROM ra_out")
_ALT = ("CASE WHEN lang <> 'en' THEN concat('Aufgabe: ', problem, CASE WHEN length(problem) % 7 = 0 THEN ' Figure 3' ELSE '' END) END")
CUR_2 = curate_sql("rb", "reasoning2", "reasoning", "problem2", "response", "think", "id", correct="grade", min_tok=10)
ORACLE["alternate_question"] = _with(("reasoning",), f"reasoning2 AS (SELECT *, {_ALT} AS problem2 FROM reasoning)," + CUR_R0 + "," + CUR_2 + """,
ev AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', '3407', CAST(id AS VARCHAR))), id) AS rk, a.problem AS p1, b.problem AS p2
   FROM (SELECT row_id AS id FROM ra_out UNION SELECT row_id FROM rb_out) i LEFT JOIN ra_out a ON a.row_id = i.id LEFT JOIN rb_out b ON b.row_id = i.id),
walk AS (SELECT 1 AS rk, 0 AS parity UNION ALL
   SELECT w.rk + 1, CASE WHEN w.parity = 0 THEN (CASE WHEN e.p1 IS NOT NULL THEN 1 ELSE 0 END) ELSE (CASE WHEN e.p2 IS NOT NULL THEN 0 ELSE 1 END) END
   FROM walk w JOIN ev e ON e.rk = w.rk)
SELECT e.id AS row_id, CASE WHEN w.parity = 0 THEN p1 ELSE p2 END AS problem FROM ev e JOIN walk w ON w.rk = e.rk
WHERE CASE WHEN w.parity = 0 THEN p1 ELSE p2 END IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["write_records"] = _with(("reasoning",), CUR_R0 + " SELECT * FROM ra_out")
ORACLE["build_corpus"] = _with(("completions",), CUR_R + "," + CUR_C + " SELECT * FROM ra_out UNION ALL SELECT * FROM cb_out")
ORACLE["build_test_set"] = _with(("reasoning",), curate_sql("ts", "reasoning", "test", "problem", "response", None, "id", signal="So ")
                                 + " SELECT * FROM ts_out")
_DEC = lambda topic_expr, src="reasoning": (
    f"dec AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {o.key('coalesce(problem, ' + Q('') + ')')} ORDER BY id) > 1 "
    f"THEN 'duplicate' WHEN NOT contains(coalesce(response, ''), {Q(chr(92) + 'boxed')}) THEN 'no_boxed' "
    f"WHEN {topic_expr} THEN 'topic' ELSE 'other' END AS decision FROM {src})")
ORACLE["filter_topic"] = _with(("reasoning", "verdicts"), "rv AS (SELECT r.*, v.is_topic AS v_topic FROM reasoning r LEFT JOIN verdicts v ON v.id = r.id), "
                               + _DEC(f"({o.topic('problem')} OR coalesce(v_topic, false))", "rv") + " SELECT id FROM dec WHERE decision = 'topic'")
ORACLE["filter_topic_dataset"] = _with(("reasoning",), _DEC(o.topic("problem")) + " SELECT id FROM dec WHERE decision = 'topic'")
ORACLE["write_with_rejects"] = _with(("reasoning",), _DEC(o.topic("problem")) + " SELECT id, decision FROM dec WHERE decision IN ('topic', 'other')")
ORACLE["split_corpus"] = _with(("reasoning",), CUR_R + ", cur AS (SELECT row_id AS id, problem, think FROM ra_out), " + UNIQ.replace("FROM reasoning", "FROM cur") + """,
nv AS (SELECT k, CAST(floor(k * (CAST(0.017 AS DOUBLE) / (CAST(0.017 AS DOUBLE) + CAST(0.032 AS DOUBLE)))) AS BIGINT) AS nval FROM sz),
vgrid AS (SELECT CAST(floor(CAST(g.range AS DOUBLE) * (CAST(nv.k AS DOUBLE) / nv.nval)) AS BIGINT) AS i FROM nv, range(nv.nval) g)
SELECT rk.id AS row_id, CASE WHEN grid.i IS NULL THEN 'train' WHEN vgrid.i IS NOT NULL THEN 'val' ELSE 'test' END AS split
FROM rk LEFT JOIN grid ON grid.p = rk.rank LEFT JOIN vgrid ON vgrid.i = grid.i""")
ORACLE["evaluate_runs"] = ORACLE["eval_accuracy"]
ORACLE["score_completions"] = _with(_C, CORRECT + ", " + REP + f""",
e AS (SELECT prompt_id, min(length(content)) AS mn, max(length(content)) AS mx FROM k5 GROUP BY prompt_id),
parts AS (SELECT k5.completion_id, CAST(k5.is_correct AS DOUBLE) AS accuracy,
   CASE WHEN mx = mn THEN 0.0 WHEN is_correct THEN 0.5 - CAST(length(content) - mn AS DOUBLE) / (mx - mn)
        ELSE least(0.0, 0.5 - CAST(length(content) - mn AS DOUBLE) / (mx - mn)) END AS length,
   CASE WHEN {o.count_literal('k5.content', chr(10) + '</think>' + chr(10))} = 1 THEN 1.0 ELSE 0.0 END AS fmt,
   {_cos_raw(f'least(({_MT.replace("content", "k5.content")}) / 15.0, 1.0)')} AS cm,
   rep.r AS rp FROM k5 JOIN e USING (prompt_id) JOIN rep ON rep.completion_id = k5.completion_id)
SELECT completion_id, round(accuracy, 9) AS accuracy, round(length, 9) AS length, round(1.0 * fmt + 2.0 * cm + 0.1 * rp, 9) AS total FROM parts""")
ORACLE["compare_answers"] = duckdb_ctes("answer_pairs", "verdicts") + (
    f"SELECT a.id, {o.parse_verdict('v.verdict_text')} AS equivalent FROM answer_pairs a LEFT JOIN verdicts v ON v.id = a.id")

# ---- 2.1 sources / sinks ----
ORACLE["read_jsonl"] = _R + "SELECT id, problem, answer, grade FROM reasoning"
ORACLE["read_text_blob"] = "SELECT CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents"
ORACLE["read_json_records"] = "SELECT conv_id, turn, role, text FROM conversations"
ORACLE["read_dataset"] = _R + "SELECT id, problem FROM reasoning WHERE lang = 'en'"
ORACLE["stream_dataset"] = ORACLE["read_dataset"]
ORACLE["write_jsonl_with_summary"] = duckdb_ctes("answer_pairs", "verdicts") + (
    f'SELECT count(*) FILTER (WHERE eq = true) AS "true", count(*) FILTER (WHERE eq = false) AS "false" FROM '
    f"(SELECT {o.parse_verdict('v.verdict_text')} AS eq FROM answer_pairs a LEFT JOIN verdicts v ON v.id = a.id)")
ORACLE["write_eval_details"] = _with(("completions",), DETAILS + """
SELECT sample_id, problem AS question, gold AS ground_truth, pred AS prediction, raw_output, token_generated, is_correct FROM g5""")
ORACLE["append_result"] = _with(("completions",), DETAILS + """,
summ AS (SELECT lang, coalesce(sum(CAST(is_correct AS BIGINT)) / count(*) * 100.0, 0.0) AS accuracy,
   coalesce(sum(token_generated) / count(*), 0.0) AS avg_tokens FROM g5 GROUP BY lang),
models AS (SELECT unnest(['fixture-a', 'fixture-b']) AS model)
SELECT model, 'reasoning' AS dataset, printf('%.2f', accuracy) AS accuracy, printf('%.2f', avg_tokens) AS avg_tokens_generated, true AS dated, count(*) AS n
FROM summ, models GROUP BY ALL""")

# ---- 2.10 streams ----
ORACLE["stream_topk"] = ORACLE["topk_rewards"]
ORACLE["stream_best_step"] = ORACLE["best_step"]
ORACLE["stream_curate"] = _with(("reasoning",), CUR_R + f" SELECT DISTINCT md5({o.key('problem')}) AS key_md5 FROM ra_out")
ORACLE["stream_dedup"] = _R + f"SELECT DISTINCT md5({o.key('problem')}) AS key_md5 FROM reasoning"

# answers are read by a recursive CTE
for _name, _sql in list(ORACLE.items()):
    if "UNION ALL SELECT s, lane, substr(" in _sql and not _sql.startswith("WITH RECURSIVE "):
        ORACLE[_name] = _sql.replace("WITH ", "WITH RECURSIVE ", 1)
