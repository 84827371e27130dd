"""Building blocks of the DuckDB oracle SQL.

The oracle is an independent, token-table formulation (one row per word,
joins against lexicon VALUES, window functions and ordered string
aggregation), in contrast to the engine's row-local array expressions.
Only the parameters (lexicons, shape table, draw arithmetic) are shared.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.draws import draw_sql, pick_sql

WS = r"[ \t\n\r\f\x0B]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fmt(x: str) -> str:
    """D1 format_sentences."""
    return (f"regexp_replace(regexp_replace({strip_ws(x)}, '([?.,!''])', ' \\1', 'g'), "
            f"'{WS}+', ' ', 'g')")


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def inflect(word: str, number: str) -> str:
    efin = ", ".join(q(v) for v in L.E_FINAL_VERBS)
    return (f"(CASE WHEN {word} LIKE '%ed' THEN substr({word}, 1, length({word}) - 2) || "
            f"CASE WHEN {number} = 'sg' THEN (CASE WHEN {word} IN ({efin}) THEN 'es' ELSE 's' END) "
            f"ELSE (CASE WHEN {word} IN ({efin}) THEN 'e' ELSE '' END) END ELSE {word} END)")


def shapes_values() -> str:
    rows = ", ".join(f"({s.shape_id}, {q(s.subj_mods)}, {q(s.obj_mods)}, {s.weight}, {s.lo}, {s.hi}, "
                     f"{q(s.template)}, {s.verb_pos})" for s in L.SHAPES)
    return f"(SELECT * FROM (VALUES {rows}) t(shape_id, subj_mods, obj_mods, weight, lo, hi, template, verb_pos))"


def sampling_lex_values(lang: str) -> str:
    g = L.SAMPLING_GRAMMARS[lang]
    rows = ([("N", "sg", i, w) for i, w in enumerate(g.nouns_sg)] +
            [("N", "pl", i, w) for i, w in enumerate(g.nouns_pl)] +
            [("V", "", i, w) for i, w in enumerate(g.verbs)] +
            [("P", "", i, w) for i, w in enumerate(g.preps)] +
            [("D", "", 0, L.DETERMINER), ("C", "", 0, L.COMPLEMENTIZER)])
    vals = ", ".join(f"({q(t)}, {q(n)}, {i}, {q(w)})" for t, n, i, w in rows)
    return f"(VALUES {vals}) t(tag, number, idx, word)"


def parse_lex_values(langs=None) -> str:
    rows = L.lexicon_rows(langs)
    vals = ", ".join(f"({q(lg)}, {q(w)}, {q(t)}, {q(n) if n else 'NULL'})" for lg, w, t, n in rows)
    return f"(VALUES {vals}) t(lang, word, tag, number)"


def keys_cte(p: str = "") -> str:
    return (f"{p}keys AS (SELECT id, id AS key, '' AS salt FROM "
            f"(SELECT DISTINCT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id FROM lineitem))")


def corpus_ctes(p: str = "", lang: str = "en_RC_PP", pres_p: float = 0.5, harmonize: bool = False,
                keys: str | None = None) -> list:
    """Token table {p}tok (id, pos, tag, number, idx, word, tword, ...) and
    sentence table {p}corpus (id, shape_id, verb_pos, tense, prefix, src, tgt)."""
    g = L.SAMPLING_GRAMMARS[lang]
    permille = int(round(pres_p * 1000))
    d = lambda slot, t="k": draw_sql(f"{t}.key", slot, f"{t}.salt")
    u = pick_sql(d("0"), L.SHAPE_TOTAL)
    ctes = []
    if keys is None:
        ctes.append(keys_cte(p))
        keys = f"{p}keys"
    ctes.append(f"""{p}sent AS (
  SELECT k.id, k.key, k.salt, s.shape_id, s.subj_mods, s.obj_mods, s.template, s.verb_pos,
         CASE WHEN {pick_sql(d('1'), 1000)} < {permille} THEN 'pres' ELSE 'past' END AS tense,
         CASE WHEN {pick_sql(d('5'), 2)} = 0 THEN 'sg' ELSE 'pl' END AS head_number
  FROM (SELECT k.*, {u} AS u FROM {keys} k) k JOIN {shapes_values()} s ON k.u >= s.lo AND k.u < s.hi)""")
    ctes.append(f"""{p}tok0 AS (
  SELECT s.*, r.pos, substr(s.template, CAST(r.pos AS INTEGER) + 1, 1) AS tag
  FROM {p}sent s JOIN range(0, {L.MAX_SENTENCE_WORDS}) r(pos) ON r.pos < length(s.template))""")
    harm = "TRUE" if harmonize else "FALSE"
    ctes.append(f"""{p}tok1 AS (
  SELECT *,
    CASE WHEN tag = 'N' THEN
      CASE WHEN {harm} AND tense = 'pres' AND pos < verb_pos THEN head_number
           WHEN {pick_sql(d('3 + 2 * pos', 't'), 2)} = 0 THEN 'sg' ELSE 'pl' END END AS number,
    CASE tag WHEN 'N' THEN {pick_sql(d('2 + 2 * pos', 't'), len(g.nouns_sg))}
             WHEN 'V' THEN {pick_sql(d('2 + 2 * pos', 't'), len(g.verbs))}
             WHEN 'P' THEN {pick_sql(d('2 + 2 * pos', 't'), len(g.preps))}
             ELSE 0 END AS idx
  FROM {p}tok0 t)""")
    ctes.append(f"{p}lex AS (SELECT * FROM {sampling_lex_values(lang)})")
    ctes.append(f"""{p}tok AS (
  SELECT t.*, l.word,
    CASE WHEN t.tense = 'pres' AND t.pos = t.verb_pos THEN {inflect('l.word', 't.head_number')} ELSE l.word END AS tword
  FROM {p}tok1 t JOIN {p}lex l ON l.tag = t.tag AND l.idx = t.idx AND l.number = coalesce(t.number, ''))""")
    ctes.append(f"""{p}corpus AS (
  SELECT id, shape_id, subj_mods, obj_mods, verb_pos, tense, tense AS prefix, head_number,
    {cap("string_agg(word, ' ' ORDER BY pos)")} || '.' AS src,
    {cap("string_agg(tword, ' ' ORDER BY pos)")} || '.' AS tgt,
    string_agg(word, ' ' ORDER BY pos) AS src_plain
  FROM {p}tok GROUP BY id, shape_id, subj_mods, obj_mods, verb_pos, tense, head_number)""")
    return ctes


def meta_ctes(p: str = "") -> list:
    """Metadata per sentence ({p}meta) from the token table {p}tok."""
    return [
        f"""{p}ft AS (
  SELECT t.id, t.pos, t.tag, t.number, t.word,
    lag(t.tag, 1) OVER (PARTITION BY t.id ORDER BY t.pos) AS prev1,
    lag(t.tag, 2) OVER (PARTITION BY t.id ORDER BY t.pos) AS prev2
  FROM {p}tok t)""",
        f"""{p}fv AS (
  SELECT id,
    min(pos) FILTER (WHERE tag = 'V' AND coalesce(prev1, '') <> 'C') AS vpos,
    min(pos) FILTER (WHERE tag = 'N') AS hpos,
    arg_min(number, pos) FILTER (WHERE tag = 'N') AS subj,
    '[' || string_agg(tag, '] [' ORDER BY pos) || ']' AS pos_sequence
  FROM {p}ft GROUP BY id)""",
        f"""{p}fo AS (
  SELECT f.id, arg_min(f.number, f.pos) FILTER (WHERE f.tag = 'N' AND f.pos > v.vpos) AS object_number,
         max(CASE WHEN f.pos = v.vpos THEN f.word END) AS main_verb
  FROM {p}ft f JOIN {p}fv v USING (id) GROUP BY f.id)""",
        f"""{p}fi AS (
  SELECT f.id, f.pos, f.number, v.subj, CASE WHEN f.prev2 = 'P' THEN 'PP' ELSE 'CP' END AS intro
  FROM {p}ft f JOIN {p}fv v USING (id)
  WHERE f.tag = 'N' AND f.pos > v.hpos AND f.pos < v.vpos)""",
        f"""{p}fr AS (
  SELECT *,
    sum(CASE WHEN intro = 'PP' THEN 1 ELSE 0 END) OVER w AS n_pp,
    sum(CASE WHEN intro = 'CP' THEN 1 ELSE 0 END) OVER w AS n_cp
  FROM {p}fi WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""{p}fa AS (
  SELECT id, count(*) AS n_inter,
    arg_max(number, pos) AS final_intervener_number,
    count(*) FILTER (WHERE number <> subj) AS n_dist,
    string_agg(CASE WHEN n_pp > 0 AND n_cp > 0 THEN 'both' WHEN n_pp > 0 THEN 'PP' ELSE 'CP' END, ',' ORDER BY pos) AS each_lab,
    arg_max(CASE WHEN n_pp > 0 AND n_cp > 0 THEN 'both' WHEN n_pp > 0 THEN 'PP' ELSE 'CP' END, pos) AS last_lab,
    string_agg(CASE WHEN number = 'sg' THEN 'S' ELSE 'P' END, '' ORDER BY pos) AS letters,
    string_agg(CASE WHEN intro = 'CP' THEN 'RC' ELSE 'PP' END, '_' ORDER BY pos) AS own
  FROM {p}fr GROUP BY id)""",
        f"""{p}meta AS (
  SELECT v.id, v.subj AS subject_number,
    CAST(v.vpos AS INTEGER) AS predict_identical_until_given_word_number,
    o.object_number, o.main_verb,
    {inflect('o.main_verb', "'sg'")} || ',' || {inflect('o.main_verb', "'pl'")} AS predict_from_given_words_after_identical,
    a.final_intervener_number,
    CAST(coalesce(a.n_dist, 0) AS INTEGER) AS n_distractors,
    CASE WHEN coalesce(a.n_dist, 0) > 0 THEN a.each_lab END AS each_distractor_structure,
    CASE WHEN coalesce(a.n_dist, 0) > 0 THEN a.last_lab END AS distractor_structures,
    CASE WHEN coalesce(a.n_dist, 0) > 0 THEN a.last_lab END AS final_distractor_structure,
    v.pos_sequence,
    CASE WHEN coalesce(a.n_inter, 0) <= 2 THEN
      (CASE WHEN v.subj = 'sg' THEN 'S' ELSE 'P' END) || coalesce(a.letters, '') ||
      (CASE WHEN coalesce(a.n_inter, 0) > 0 THEN '_' || a.own ELSE '' END) END AS condition,
    CAST(coalesce(a.n_inter, 0) AS INTEGER) AS n_interveners
  FROM {p}fv v JOIN {p}fo o USING (id) LEFT JOIN {p}fa a USING (id))""",
    ]


def preds_ctes(p: str = "") -> list:
    """{p}preds (id, iteration, pred, gold, tense, verb_pos) from {p}tok/{p}corpus."""
    return [
        f"""{p}pt AS (
  SELECT t.*, t.id % 10 AS kind,
    min(CASE WHEN t.tag = 'N' AND t.pos > 1 AND t.pos < t.verb_pos THEN t.pos END) OVER (PARTITION BY t.id) AS first_inter
  FROM {p}tok t)""",
        f"""{p}pw AS (
  SELECT x.id, x.pos,
    CASE WHEN x.kind = 5 AND x.pos = x.verb_pos THEN {inflect('x.word', "CASE WHEN x.head_number = 'sg' THEN 'pl' ELSE 'sg' END")}
         WHEN x.kind = 7 AND x.pos = x.verb_pos + 2 THEN 'banana'
         WHEN x.kind = 8 AND x.pos = x.verb_pos THEN x.word
         WHEN x.kind = 9 AND x.pos = x.first_inter THEN fl.word
         ELSE x.tword END AS pword
  FROM {p}pt x LEFT JOIN {p}lex fl
    ON x.tag = 'N' AND fl.tag = 'N' AND fl.idx = x.idx
   AND fl.number = CASE WHEN x.number = 'sg' THEN 'pl' ELSE 'sg' END)""",
        f"""{p}preds AS (
  SELECT c.id, CAST(520 * (1 + c.id % 15) AS INTEGER) AS iteration, c.tense, c.verb_pos,
    {fmt(f"CASE WHEN c.id % 10 = 6 THEN lower(c.tgt) ELSE {cap('w.s')} || '.' END")} AS pred,
    {fmt('c.tgt')} AS gold
  FROM {p}corpus c JOIN (SELECT id, string_agg(pword, ' ' ORDER BY pos) AS s FROM {p}pw GROUP BY id) w USING (id))""",
    ]


def parse_ctes(p: str, src: str, text: str, lang_sql: str, k: str | None = None,
               max_words: int | None = None, strip: str = r" [.?!]$") -> list:
    """Tag + accept sentences of ``src`` (columns id, {text}[, {k}]).

    Produces {p}ptoks (id, stage, pos, w, tag, number) and {p}pacc (id, stage,
    ok) for stage 1 (capped words) and, when ``k`` is given, stage 2 (first
    k+1 words + [EOS])."""
    cap_clause = f"WHERE pos <= {max_words}" if max_words else ""
    s2 = ""
    if k:
        s2 = f"""
  UNION ALL
  SELECT id, 2 AS stage, lang, pos, w FROM (
    SELECT id, lang, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM (
      SELECT id, {lang_sql} AS lang, list_concat(
          list_transform(list_slice({split_words(text)}, 1, {k} + 1), lambda x: replace(lower(x), '[eos]', '[EOS]')),
          ['[EOS]']) AS toks
      FROM {src} WHERE {k} IS NOT NULL))"""
    return [
        f"""{p}ptoks0 AS (
  SELECT id, 1 AS stage, lang, pos, w FROM (
    SELECT id, lang, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM (
      SELECT id, {lang_sql} AS lang, {split_words(f"regexp_replace(lower({text}), '{strip}', '')")} AS toks FROM {src}))
  {cap_clause}{s2})""",
        f"""{p}plex AS (SELECT * FROM {parse_lex_values()})""",
        f"""{p}ptoks AS (
  SELECT t.id, t.stage, t.lang, t.pos, t.w, l.tag, l.number,
    lag(l.tag, 1) OVER (PARTITION BY t.id, t.stage ORDER BY t.pos) AS prev1
  FROM {p}ptoks0 t LEFT JOIN {p}plex l ON l.lang = t.lang AND l.word = t.w)""",
        f"""{p}pacc AS (
  SELECT id, stage, lang,
    count(*) = count(tag) AND regexp_full_match(string_agg(coalesce(tag, '?'), '' ORDER BY pos),
      CASE lang {' '.join(f"WHEN {q(lg)} THEN {q(L.TAG_PATTERNS[lg])}" for lg in L.SUPPORTED_LANGS)} END) AS ok,
    string_agg(coalesce(tag, '?'), '' ORDER BY pos) AS tagstr,
    count(*) - count(tag) AS n_unknown, count(*) AS n_tokens
  FROM {p}ptoks GROUP BY id, stage, lang)""",
    ]


def subject_view_ctes(p: str, chosen: str) -> list:
    """Head number, distractor flag, main verb, final intervener per (id) for
    the tokens of the chosen stage: ``chosen`` has (id, stage)."""
    return [
        f"""{p}ct AS (SELECT t.* FROM {p}ptoks t JOIN {chosen} c ON c.id = t.id AND c.stage = t.stage)""",
        f"""{p}cv AS (
  SELECT id,
    min(pos) FILTER (WHERE tag = 'N') AS hpos,
    arg_min(number, pos) FILTER (WHERE tag = 'N') AS subj,
    min(pos) FILTER (WHERE tag = 'V' AND coalesce(prev1, '') <> 'C') AS vpos,
    arg_min(w, pos) FILTER (WHERE tag = 'V' AND coalesce(prev1, '') <> 'C') AS verb
  FROM {p}ct GROUP BY id)""",
        f"""{p}ce AS (
  SELECT t.id, min(t.pos) FILTER (WHERE t.tag = 'V' AND coalesce(t.prev1, '') <> 'C' AND t.pos > v.hpos) AS epos
  FROM {p}ct t JOIN {p}cv v USING (id) GROUP BY t.id)""",
        f"""{p}cd AS (
  SELECT v.id, v.subj, v.verb,
    coalesce(bool_or(t.number <> v.subj), FALSE) AS has_dist,
    arg_max(t.number, t.pos) AS final_number,
    count(t.pos) AS n_inter
  FROM {p}cv v JOIN {p}ce e USING (id)
  LEFT JOIN {p}ct t ON t.id = v.id AND t.tag = 'N' AND t.pos > v.hpos AND t.pos < coalesce(e.epos, 1000000)
  GROUP BY v.id, v.subj, v.verb)""",
    ]


def with_ctes(ctes: list, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
