"""The registered queries as SQL for DuckDB, on the whole test tables.

DuckDB's ``levenshtein`` counts bytes. The tables hold eleven letters outside ASCII;
``_norm`` maps each to an unused upper-case letter after lower-casing, so that bytes are
characters and distances agree.

The one-to-one alignment is written as a dynamic program over the set of used previous
records, one common table expression per current record. It is the exact optimum for
blocks of up to eight previous records, which covers every conversation.
"""

from __future__ import annotations

_REWORD = "replace(replace(replace(replace({c},' the ',' this '),' la ',' sa '),' die ',' jene '),' de ',' del ')"


def _reword(c: str) -> str:
    return _REWORD.format(c=c)


def _norm(c: str) -> str:
    return rf"translate(lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))), 'éóèñçüêäöíß', 'ABCDEFGHIJK')"


def _sim(a: str, b: str) -> str:
    """Similarity of two columns that hold normalised text."""
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE END"
    )


TURNS = f"""
t AS (
  SELECT conv_id::VARCHAR pair_id, 'prev' side, (turn + 2)::INT row_num, turn::INT turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id::VARCHAR, 'curr', (turn + 2)::INT, turn::INT, role,
         CASE WHEN role = 'system' THEN reverse(text) ELSE {_reword('text')} END
  FROM conversations WHERE length(text) >= 60
)"""

RISK = f"""{TURNS},
r AS (
  SELECT pair_id, side, row_num, text,
    role[1] || '.' || turn || CASE WHEN side = 'curr' AND role = 'assistant' AND length(text) > 1000 THEN 'x' ELSE '' END number,
    CASE WHEN side = 'prev' THEN 'Explain ' || role WHEN role = 'user' THEN 'EXPLAIN  user'
         WHEN role = 'assistant' AND length(text) > 500 THEN 'Explain assistant reply' ELSE 'Explain ' || role END explanation,
    CASE role WHEN 'user' THEN 'List' WHEN 'assistant' THEN 'WholeNumber' END dv_type,
    CASE role WHEN 'assistant' THEN 'Between' END dv_op,
    CASE role WHEN 'user' THEN CASE side WHEN 'prev' THEN '"Yes,No,' || turn || '"' ELSE '"' || turn || ', No,Yes"' END WHEN 'assistant' THEN '1' END dv_f1,
    CASE role WHEN 'assistant' THEN length(text)::VARCHAR END dv_f2,
    CASE WHEN role = 'assistant' AND length(text) > 800 THEN 'Expression' END cf_type,
    CASE WHEN role = 'assistant' AND length(text) > 800 THEN 'Equal' END cf_op,
    CASE WHEN role = 'assistant' AND length(text) > 800 THEN '=LEN(C' || row_num || ')>800' END cf_v1,
    NULL::VARCHAR cf_v2
  FROM t
  UNION ALL
  SELECT conv_id::VARCHAR, 'curr', greatest(12, max(turn) + 3)::INT, 'Closing remarks after ' || count(*) || ' turns.', NULL, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM conversations GROUP BY conv_id
),
q AS (
  SELECT r.pair_id, r.side,
    CASE WHEN r.row_num <= 5 THEN r.row_num ELSE 2097152 + r.row_num END::BIGINT ord,
    CASE WHEN r.row_num <= 5 THEN 'Conversation' ELSE coalesce(h.text, '') END section,
    r.* EXCLUDE (pair_id, side)
  FROM r LEFT JOIN r h ON h.pair_id = r.pair_id AND h.side = r.side AND h.row_num = 5
  WHERE regexp_matches(r.text, '\\S')
)"""

GENERAL = f"""{TURNS},
r AS (
  SELECT pair_id, side, row_num, text, role || '.' || turn AS label, text AS d, length(text)::VARCHAR AS e,
    CASE WHEN length(text) > CASE side WHEN 'curr' THEN 310 ELSE 300 END
         THEN CASE WHEN side = 'curr' AND role = 'user' THEN 'LONG' ELSE 'long' END END AS f,
    CASE WHEN role <> 'system' THEN 'See ' || role END AS g
  FROM t
),
q AS (
  SELECT a.pair_id, a.side, a.row_num::BIGINT ord, 'Dialogue' section, a.label AS number, trim(a.text) AS text,
         a.row_num, a.label || '|' || coalesce(b.label, '') labels
  FROM r a LEFT JOIN r b ON b.pair_id = a.pair_id AND b.side = a.side AND b.row_num = a.row_num + 1
  WHERE a.row_num % 2 = 0 AND regexp_matches(a.text, '\\S')
),
qc AS (
  SELECT q.pair_id, q.side, q.ord, q.section, q.number, c.kind, (r.row_num - q.row_num)::INT row_offset, c.col, c.col_ord, c.cell_text
  FROM q JOIN r ON r.pair_id = q.pair_id AND r.side = q.side AND r.row_num IN (q.row_num, q.row_num + 1)
  CROSS JOIN LATERAL (VALUES ('answer', 'D', 1, r.d), ('answer', 'E', 2, r.e), ('answer', 'F', 3, r.f), ('explanation', 'G', 0, r.g)) c(kind, col, col_ord, cell_text)
  WHERE c.cell_text IS NOT NULL AND regexp_matches(c.cell_text, '\\S')
)"""


def _align(rows: int) -> str:
    """CTEs ``m(pair_id, n_ord, o_ord, similarity, adj, second_best)`` from ``q``; at most ``rows`` current records."""
    levels = []
    for k in range(rows):
        levels.append(f"""
l{k + 1} AS (
  SELECT pair_id, mask, max(total) total, arg_max(path, total) path FROM (
    SELECT l.pair_id, l.mask | (1 << s.j) mask, l.total + s.adj total, list_append(l.path, s.j) path
    FROM l{k} l JOIN sc s ON s.pair_id = l.pair_id AND s.i = {k} AND (l.mask >> s.j) & 1 = 0
    UNION ALL SELECT pair_id, mask, total, list_append(path, -1) FROM l{k}
  ) GROUP BY pair_id, mask
)""")
    return f"""
n AS (SELECT *, (row_number() OVER (PARTITION BY pair_id ORDER BY ord) - 1)::INT i, {_norm('text')} nt FROM q WHERE side = 'curr'),
o AS (SELECT *, (row_number() OVER (PARTITION BY pair_id ORDER BY ord) - 1)::INT j, {_norm('text')} nt FROM q WHERE side = 'prev'),
b AS (
  SELECT n.pair_id, n.i, o.j, n.ord n_ord, o.ord o_ord, {_sim('n.nt', 'o.nt')} base,
    (CASE WHEN n.section <> '' AND n.section = o.section THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN n.number <> '' AND n.number = o.number THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) bonus
  FROM n JOIN o ON n.pair_id = o.pair_id
),
sc AS (SELECT *, CASE WHEN bonus > 0 THEN least(1.0::DOUBLE, base + bonus) ELSE base END adj FROM b),
l0 AS (SELECT DISTINCT pair_id, 0 mask, 0.0::DOUBLE total, []::INT[] path FROM n),
{','.join(levels)},
best AS (SELECT pair_id, arg_max(path, total) path FROM l{rows} GROUP BY pair_id),
chosen AS (SELECT pair_id, unnest(path) j, generate_subscripts(path, 1) - 1 i FROM best),
m AS (
  SELECT s.pair_id, s.n_ord, s.o_ord, s.base similarity, s.adj,
    (SELECT max(x.base) FROM sc x WHERE x.pair_id = s.pair_id AND x.i = s.i AND x.j <> s.j) second_best
  FROM chosen c JOIN sc s ON s.pair_id = c.pair_id AND s.i = c.i AND s.j = c.j WHERE s.adj >= 0.5
),
al AS (
  SELECT n.pair_id, n.ord n_ord, m.o_ord, m.similarity, m.second_best FROM n LEFT JOIN m ON m.pair_id = n.pair_id AND m.n_ord = n.ord
  UNION ALL
  SELECT o.pair_id, NULL, o.ord, NULL, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair_id = o.pair_id AND m.o_ord = o.ord)
)"""


def _items(c: str) -> str:
    return f"list_sort(list_filter(list_transform(string_split(trim({c}, '\"'), ','), lambda x: trim(x)), lambda x: length(x) > 0))"


def _dv_changed(o: str, n: str) -> str:
    inline = " AND ".join(f"NOT starts_with({x}_f1, '=') AND NOT contains({x}_f1, '$')" for x in (o, n))
    return (
        f"CASE WHEN {o}_type IS DISTINCT FROM {n}_type THEN true WHEN {o}_type IS NULL THEN false "
        f"WHEN {o}_type = 'List' THEN CASE WHEN {inline} THEN {_items(o + '_f1')} <> {_items(n + '_f1')} ELSE lower({o}_f1) <> lower({n}_f1) END "
        f"ELSE {o}_op IS DISTINCT FROM {n}_op OR {o}_f1 IS DISTINCT FROM {n}_f1 OR {o}_f2 IS DISTINCT FROM {n}_f2 END"
    )


def _cf_changed(o: str, n: str) -> str:
    return " OR ".join(f"{o}_{k} IS DISTINCT FROM {n}_{k}" for k in ("type", "op", "v1", "v2"))


RISK_DIFF = f"""WITH {RISK}, {_align(9)},
f AS (
  SELECT al.*, n.section n_section, o.section o_section, n.number n_number, o.number o_number, n.text n_text, o.text o_text, n.explanation n_expl, o.explanation o_expl,
    n.row_num n_row, o.row_num o_row,
    CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN al.similarity < 1 END text_changed,
    CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN n.number IS DISTINCT FROM o.number END number_changed,
    CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN {_dv_changed('o.dv', 'n.dv')} END dv_changed,
    CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN {_cf_changed('o.cf', 'n.cf')} END cf_changed,
    CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN {_norm('n.explanation')} <> {_norm('o.explanation')} END explanation_changed
  FROM al LEFT JOIN n ON n.pair_id = al.pair_id AND n.ord = al.n_ord LEFT JOIN o ON o.pair_id = al.pair_id AND o.ord = al.o_ord
),
d AS (
  SELECT *, CASE WHEN o_ord IS NULL THEN 'added' WHEN n_ord IS NULL THEN 'removed'
    WHEN text_changed OR number_changed OR dv_changed OR cf_changed OR explanation_changed THEN 'changed' ELSE 'unchanged' END status
  FROM f
)"""

SHEET = f"""{RISK_DIFF},
v AS (
  SELECT 'current' AS "view", pair_id, status, n_row row_num, CASE status WHEN 'changed' THEN 1 WHEN 'unchanged' THEN 2 ELSE 0 END rk, n_ord ord,
    CASE status WHEN 'changed' THEN o_section ELSE n_section END section, n_number number, n_text AS text
  FROM d WHERE status <> 'removed'
  UNION ALL
  SELECT 'previous', pair_id, status, o_row, CASE status WHEN 'changed' THEN 1 WHEN 'unchanged' THEN 2 ELSE 0 END, o_ord,
    CASE status WHEN 'unchanged' THEN n_section ELSE o_section END, CASE status WHEN 'unchanged' THEN n_number ELSE o_number END,
    CASE status WHEN 'unchanged' THEN n_text ELSE o_text END
  FROM d WHERE status <> 'added'
)"""

RULE = "dv_type, dv_op, dv_f1, dv_f2, cf_type, cf_op, cf_v1, cf_v2"

RULE_PAIRS = """WITH b AS (
  SELECT p_partkey, p_type, p_size, p_size::VARCHAR txt, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) c,
    CASE WHEN p_size < 10 THEN 'List' WHEN p_size < 20 THEN 'WholeNumber' WHEN p_size < 30 THEN 'Date' WHEN p_size < 35 THEN 'Time'
         WHEN p_size < 40 THEN 'Custom' WHEN p_size < 45 THEN 'AnyValue' WHEN p_size < 48 THEN 'TextLength' END kind,
    CASE WHEN p_size % 2 = 0 THEN 'Between' ELSE 'GreaterThan' END op,
    CASE WHEN p_size % 2 = 0 THEN '99' END f2,
    CASE WHEN p_size < 20 THEN 'CellIs' WHEN p_size < 35 THEN 'Expression' WHEN p_size < 45 THEN 'ColorScale' END cf_type,
    CASE WHEN p_size % 3 = 0 THEN 'NotBetween' ELSE 'EqualOrLessThan' END cf_op
  FROM part
),
p AS (
  SELECT *, CASE WHEN kind = 'List' AND p_size < 5 THEN '"' || a || ' ,' || c || '"' WHEN kind = 'List' THEN '=$A$1:$A$' || txt
      WHEN kind = 'Time' THEN '0.' || txt WHEN kind = 'Date' THEN '45' || lpad(txt, 3, '1') || '.25' ELSE txt END old_f1,
    CASE WHEN kind = 'Custom' AND p_type = 'PROMO' THEN NULL ELSE kind END new_kind,
    CASE WHEN p_type = 'SMALL' THEN '98' ELSE f2 END new_f2
  FROM b
),
rp AS (
  SELECT *, kind old_type, op old_op, f2 old_f2, new_kind new_type, op new_op,
    CASE WHEN kind = 'List' AND p_size < 3 THEN '"' || c || ' ,' || a || '"' WHEN kind = 'List' AND p_size < 5 THEN '"' || c || ' ,' || c || '"'
         WHEN kind = 'List' THEN lower(old_f1) ELSE old_f1 END new_f1
  FROM p
)"""

# Operator words.
_OPS = {
    "GreaterThan": "greater than", "Between": "between", "NotBetween": "not between", "EqualOrLessThan": "less than or equal to",
}


def _case(col: str, words: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE {col} END"


def _serial(raw: str, kind: str) -> str:
    """Serial date display; DuckDB's epoch arithmetic in milliseconds."""
    ms = f"round(try_cast({raw} AS DOUBLE) * 86400000)::BIGINT - 2209161600000"
    ts = f"make_timestamp(({ms}) * 1000)"
    return (
        f"CASE WHEN {raw} IS NULL THEN '' WHEN {kind} NOT IN ('Date', 'Time') OR try_cast({raw} AS DOUBLE) IS NULL THEN {raw} "
        f"WHEN {kind} = 'Time' THEN strftime({ts}, '%H:%M:%S') "
        f"WHEN {ts} = date_trunc('day', {ts}) THEN strftime({ts}, '%Y-%m-%d') ELSE strftime({ts}, '%Y-%m-%d %H:%M:%S') END"
    )


DOC_ROWS = f"""
dl AS (SELECT doc_id::VARCHAR pair_id, lang, source, string_split(text, chr(10)) ls FROM documents),
dr AS (
  SELECT pair_id, 'prev' side, lang, source, len(ls) total, unnest(ls) line, generate_subscripts(ls, 1)::INT - 1 pos FROM dl
),
dx AS (
  SELECT * FROM dr
  UNION ALL
  SELECT pair_id, 'curr', lang, source, total + 1, {_reword('line')}, pos FROM dr WHERE length(line) NOT BETWEEN 30 AND 60
  UNION ALL
  SELECT pair_id, 'curr', lang, source, len(ls) + 1, 'Reviewed ' || lang || ' ' || source, len(ls)::INT FROM dl
),
dc AS (
  SELECT *, (pos // 10 + 1) || '.' || (row_num + CASE WHEN side = 'curr' AND source = 'src7' THEN 1 ELSE 0 END) || ') ' || line txt
  FROM (SELECT *, pos + pos // 10 + 3 row_num, total - 1 + (total - 1) // 10 + 3 last_row FROM dx)
)"""

EXTRACT_CONTROL = rf"""WITH {DOC_ROWS},
cq AS (
  SELECT dc.* FROM dc WHERE regexp_matches(txt, '\S')
)
SELECT cq.pair_id, cq.side, cq.row_num::BIGINT ord, 'Part ' || (pos // 10 + 1) AS section, 'Document in ' || lang || ' from ' || source AS chapter,
  nullif(regexp_extract(trim(cq.txt), '^(\d+\.\d+)\)?\s*', 1), '') AS number,
  trim(regexp_replace(trim(cq.txt), '^\d+\.\d+\)?\s*', '')) AS text, cq.txt original_text, cq.row_num,
  CASE WHEN cq.row_num <= 8 THEN 'List' ELSE 'TextLength' END dv_type,
  CASE WHEN cq.row_num <= 8 THEN NULL ELSE 'LessThan' END dv_op,
  CASE WHEN cq.row_num <= 8 THEN CASE cq.side WHEN 'prev' THEN '"Yes,No"' ELSE '"No, Yes"' END
       ELSE CASE cq.side WHEN 'prev' THEN '500' ELSE length(cq.lang)::VARCHAR END END dv_f1,
  NULL::VARCHAR dv_f2,
  'CellIs' cf_type, 'Equal' cf_op, cq.lang cf_v1, NULL::VARCHAR cf_v2
FROM cq
"""

LAYOUT_SCAN = """
WITH d AS (
  SELECT pair_id, side, n - 1 + (n - 1) // 10 + 3 AS last FROM (
    SELECT doc_id::VARCHAR pair_id, s.side, len(string_split(text, chr(10))) + s.extra AS n
    FROM documents, (VALUES ('prev', 0), ('curr', 1)) s(side, extra))
)
SELECT pair_id, side, 'Control Level Questions' sheet, 'C' text_col, 'D' input_col, '1' chapter_rows,
  array_to_string(list_transform(generate_series(2, last, 11), lambda h: h || ':' || (h + 1) || '-' || least(h + 10, last)), '|') specs
FROM d"""

SECTION_SPECS = r"""
WITH raw AS (
  SELECT o_orderkey::VARCHAR pair_id, unnest([0, 1]) sec_ord, o_custkey k, o_orderstatus st, o_orderpriority pr FROM orders
)
SELECT pair_id, sec_ord::INT sec_ord,
  CASE WHEN sec_ord = 0 OR st = 'F' THEN k + 1
       WHEN pr = '1-URGENT' THEN CASE WHEN k > 0 THEN k END
       WHEN pr IN ('2-HIGH', '3-MEDIUM') THEN k + 5 WHEN st = 'O' THEN NULL ELSE k + 1 END::INT section_row,
  CASE WHEN sec_ord = 0 OR st = 'F' THEN k + 2 WHEN pr = '1-URGENT' THEN k + 1 WHEN pr = '2-HIGH' THEN k + 5 WHEN pr = '3-MEDIUM' THEN k + 9
       WHEN st = 'O' THEN 1 ELSE k + 2 END::INT first_row,
  CASE WHEN sec_ord = 0 THEN k + 9 WHEN st = 'F' THEN k + 2 WHEN pr = '1-URGENT' THEN k + 1 WHEN pr = '2-HIGH' THEN k + 9
       WHEN pr = '3-MEDIUM' THEN k + 8 WHEN st = 'O' THEN 2 END::INT last_row,
  CASE WHEN sec_ord = 0 OR st = 'F' THEN NULL WHEN pr = '1-URGENT' THEN 'format' WHEN pr = '2-HIGH' THEN 'first row not below section row'
       WHEN pr = '3-MEDIUM' THEN 'last row above first row' WHEN st = 'O' THEN 'section row' ELSE 'last row' END error
FROM raw"""

SPANS = """
WITH c AS (
  SELECT c_custkey::VARCHAR pair_id, c_nationkey n, c_mktsegment seg, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_nationkey + 7 ELSE c_nationkey + 20 END nxt
  FROM customer
),
sp AS (
  SELECT pair_id, 0 sec_ord, 0 q_ord, n + 1 section_row, n + 2 first_row, 2 span, NULL error, nxt FROM c
  UNION ALL SELECT pair_id, 0, 1, n + 1, n + 4, CASE seg WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN 2 ELSE 1 END,
    CASE seg WHEN 'MACHINERY' THEN 'question row span' WHEN 'BUILDING' THEN 'overlaps next question' END, nxt FROM c
  UNION ALL SELECT pair_id, 0, 2, n + 1, CASE seg WHEN 'BUILDING' THEN n + 4 ELSE n + 6 END, CASE seg WHEN 'BUILDING' THEN 1 ELSE 3 END, NULL, nxt FROM c
  UNION ALL SELECT pair_id, 1, 0, nxt, nxt + 1, 1, NULL, NULL FROM c
)"""


def _part_cells() -> str:
    return """
pp AS (SELECT p_brand pair_id, p_partkey k, p_size z, p_type ty, p_name nm, p_retailprice::INT pr FROM part),
prev AS (
  SELECT pair_id, 'C' || k address, nm AS text, NULL dv_f2, CASE WHEN z > 25 THEN 'old' END cf_v1 FROM (SELECT pair_id, k, z, CASE WHEN ty = 'PROMO' THEN upper(nm) ELSE nm END nm FROM pp)
  UNION ALL SELECT pair_id, 'D' || k, ty, z::VARCHAR, NULL FROM pp
  UNION ALL SELECT pair_id, 'AA' || k, floor(p_retailprice)::INT::VARCHAR, NULL, NULL FROM (SELECT p_brand pair_id, p_partkey k, p_retailprice FROM part)
),
curr AS (
  SELECT pair_id, 'C' || k address, CASE WHEN ty = 'PROMO' THEN upper(' ' || nm || chr(9)) ELSE ' ' || nm || chr(9) END AS text, NULL dv_f2,
    CASE WHEN z = 30 THEN 'new' WHEN z > 25 THEN 'old' END cf_v1 FROM pp WHERE z <> 50
  UNION ALL SELECT pair_id, 'D' || k, CASE WHEN z < 5 THEN 'SMALL' ELSE ty END, (z + CASE WHEN z > 40 THEN 1 ELSE 0 END)::VARCHAR, NULL FROM pp WHERE z <> 50
  UNION ALL SELECT p_brand, 'AA' || p_partkey, floor(p_retailprice)::INT::VARCHAR, NULL, NULL FROM part WHERE p_size <> 50
),
cd AS (
  SELECT pair_id, address, regexp_extract(address, '^[A-Z]+') col, regexp_extract(address, '[0-9]+')::INT row_num, p.text old_value, c.text new_value,
    trim(coalesce(p.text, ''), ' ' || chr(9)) <> trim(coalesce(c.text, ''), ' ' || chr(9)) text_changed,
    p.dv_f2 IS DISTINCT FROM c.dv_f2 dv_diff, p.cf_v1 IS DISTINCT FROM c.cf_v1 cf_diff, p.dv_f2 o_dv, c.dv_f2 n_dv, p.cf_v1 o_cf, c.cf_v1 n_cf
  FROM prev p FULL JOIN curr c USING (pair_id, address)
)"""


def _cell_report(full: bool) -> str:
    shown = lambda c, pre: f"CASE WHEN {c} IS NULL THEN '—' ELSE '{pre}' || {c} END" if full else "'—'"
    dv, cf = ("dv_diff", "cf_diff") if full else ("false", "false")
    return f"""WITH {_part_cells()}
SELECT pair_id, address, col, row_num, old_value, new_value, text_changed,
  CASE WHEN text_changed OR {dv} OR {cf} THEN 'changed' ELSE 'unchanged' END status,
  {shown('o_dv', 'Whole number, between, 1 and ')} old_dv, {shown('n_dv', 'Whole number, between, 1 and ')} new_dv, {dv} dv_changed,
  {shown('o_cf', 'equal to ')} old_cf, {shown('n_cf', 'equal to ')} new_cf, {cf} cf_changed
FROM cd"""


ADDRESSES = """
a AS (
  SELECT p_brand, p_size, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE 'A' || chr(64 + p_size - 25) END || p_partkey address FROM part
),
da AS (SELECT DISTINCT p_brand, address FROM a)"""

GENERAL_DIFF = f"""WITH {GENERAL}, {_align(4)},
oc AS (SELECT m.pair_id, m.n_ord, m.o_ord, c.kind, c.row_offset, c.col, c.cell_text FROM qc c JOIN m ON m.pair_id = c.pair_id AND m.o_ord = c.ord WHERE c.side = 'prev'),
nc AS (SELECT m.pair_id, m.n_ord, m.o_ord, c.kind, c.row_offset, c.col, c.cell_text FROM qc c JOIN m ON m.pair_id = c.pair_id AND m.n_ord = c.ord WHERE c.side = 'curr'),
ch AS (
  SELECT pair_id, n_ord, o_ord, kind, row_offset, col, oc.cell_text old_text, nc.cell_text new_text
  FROM oc FULL JOIN nc USING (pair_id, n_ord, o_ord, kind, row_offset, col)
  WHERE oc.cell_text IS DISTINCT FROM nc.cell_text
),
fl AS (SELECT pair_id, n_ord, o_ord, bool_or(kind = 'answer') answer_cells_changed, bool_or(kind = 'explanation') explanation_cells_changed FROM ch GROUP BY ALL)"""

# Both sides of the control sheet by place. Chapter and section of a record are those of its row.
CONTROL_PLACES = f"""WITH e AS ({EXTRACT_CONTROL}),
f AS (
  SELECT coalesce(n.pair_id, o.pair_id) pair_id, n.ord n_ord, o.ord o_ord, n.row_num n_row, o.row_num o_row, n.section n_section, o.section o_section,
    n.chapter n_chapter, o.chapter o_chapter, n.ord IS NOT NULL AND o.ord IS NOT NULL matched,
    {_norm('n.text')} <> {_norm('o.text')} text_changed, n.number IS DISTINCT FROM o.number number_changed,
    {_dv_changed('o.dv', 'n.dv')} dv_changed, {_cf_changed('o.cf', 'n.cf')} cf_changed
  FROM (SELECT * FROM e WHERE side = 'curr') n FULL JOIN (SELECT * FROM e WHERE side = 'prev') o ON n.pair_id = o.pair_id AND n.ord = o.ord
),
d AS (
  SELECT pair_id, n_ord, o_ord, n_row, o_row, n_section, o_section, n_chapter, o_chapter, CASE WHEN matched THEN text_changed END text_changed,
    CASE WHEN matched THEN number_changed END number_changed, CASE WHEN matched THEN dv_changed END dv_changed, CASE WHEN matched THEN cf_changed END cf_changed,
    CASE WHEN o_ord IS NULL THEN 'added' WHEN n_ord IS NULL THEN 'removed' WHEN text_changed OR number_changed OR dv_changed OR cf_changed THEN 'changed' ELSE 'unchanged' END status
  FROM f
)"""

CONTROL_BREAKS = f"""{CONTROL_PLACES},
v AS (
  SELECT 'current' AS "view", pair_id, n_row row_num, n_section section, n_chapter chapter FROM d WHERE status <> 'removed'
  UNION ALL SELECT 'previous', pair_id, o_row, o_section, o_chapter FROM d WHERE status <> 'added'
),
w AS (
  SELECT *, row_number() OVER k AS position, lag(section) OVER k AS above,
    last_value(nullif(chapter, '') IGNORE NULLS) OVER (PARTITION BY "view", pair_id ORDER BY row_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM v WINDOW k AS (PARTITION BY "view", pair_id ORDER BY row_num)
),
c AS (SELECT *, chapter <> '' AND chapter IS DISTINCT FROM earlier AS chapter_break FROM w)
SELECT "view", pair_id, row_num, position, chapter_break, chapter_break OR position = 1 OR section IS DISTINCT FROM above AS section_break FROM c"""

# Word counts need no walk: what a longest common subsequence leaves over is dropped or added.
WORD_COUNTS = rf"""{RISK_DIFF},
p AS (
  SELECT pair_id, n_ord, list_filter(string_split_regex(o_text, '\s+'), lambda x: x <> '') a, list_filter(string_split_regex(n_text, '\s+'), lambda x: x <> '') b
  FROM d WHERE status = 'changed'
),
lcs AS (
  WITH RECURSIVE r AS (
    SELECT pair_id, n_ord, 0 i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) best FROM p
    UNION ALL
    SELECT pair_id, n_ord, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(taken) + 1), lambda j: list_max(taken[1:j]))) FROM (
      SELECT r.pair_id, r.n_ord, i, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = a[i + 1] THEN best[j] + 1 ELSE best[j + 1] END) taken
      FROM r JOIN p ON p.pair_id = r.pair_id AND p.n_ord = r.n_ord WHERE i < len(a)
    )
  )
  SELECT p.pair_id, p.n_ord, len(a) old_words, len(b) new_words, best[len(b) + 1] same FROM p JOIN r ON r.pair_id = p.pair_id AND r.n_ord = p.n_ord AND r.i = len(p.a)
)
SELECT pair_id, n_ord, c.side, c.op, c.words FROM lcs CROSS JOIN LATERAL (VALUES ('old', 'eq', same), ('new', 'eq', same), ('old', 'del', old_words - same), ('new', 'add', new_words - same)) c(side, op, words)
WHERE c.words > 0"""

DOCUMENT = f"""{RISK_DIFF},
e AS (
  SELECT pair_id, status, row_number() OVER (PARTITION BY pair_id, status ORDER BY coalesce(n_ord, o_ord)) AS position,
    CASE status WHEN 'removed' THEN o_number WHEN 'changed' THEN NULL ELSE n_number END question_number,
    CASE WHEN status IN ('removed', 'changed') THEN o_section ELSE n_section END section,
    CASE status WHEN 'removed' THEN o_row WHEN 'added' THEN n_row END row_number,
    CASE WHEN status IN ('changed', 'unchanged') THEN o_row END previous_row, CASE WHEN status IN ('changed', 'unchanged') THEN n_row END current_row,
    CASE status WHEN 'changed' THEN o_number END previous_number, CASE status WHEN 'changed' THEN n_number END current_number,
    CASE status WHEN 'removed' THEN o_text WHEN 'changed' THEN NULL ELSE n_text END question_text,
    CASE status WHEN 'changed' THEN o_text END old_text, CASE status WHEN 'changed' THEN n_text END new_text,
    CASE status WHEN 'changed' THEN similarity WHEN 'unchanged' THEN 1.0 END similarity,
    CASE WHEN status IN ('changed', 'unchanged') THEN second_best END second_best,
    CASE status WHEN 'changed' THEN text_changed END text_changed, CASE status WHEN 'changed' THEN number_changed END number_changed,
    CASE status WHEN 'changed' THEN dv_changed END dv_changed, CASE status WHEN 'changed' THEN cf_changed END cf_changed,
    CASE status WHEN 'changed' THEN o_expl END old_explanation, CASE status WHEN 'changed' THEN n_expl END new_explanation,
    CASE status WHEN 'changed' THEN explanation_changed END explanation_changed
  FROM d
)
SELECT b.*, e.* EXCLUDE (pair_id, status) FROM (
  SELECT DISTINCT conv_id::VARCHAR pair_id, 'Risk level questions' title, conv_id || '.prev.xlsx' previous_path, conv_id || '.curr.xlsx' current_path,
    '2025-01-31T08:00:00+00:00' generated_at, unnest(['added', 'removed', 'changed', 'unchanged']) status FROM conversations
) b LEFT JOIN e ON e.pair_id = b.pair_id AND e.status = b.status"""

SQL = {
    "question_diff_tiled": f"""{RISK_DIFF} SELECT pair_id, status, n_ord, o_ord, similarity, second_best FROM d""",
    "control_flags": f"{CONTROL_PLACES} SELECT pair_id, n_ord, o_ord, status, text_changed, number_changed, dv_changed, cf_changed FROM d",
    "control_sheet_breaks": CONTROL_BREAKS,
    "word_diff_counts": WORD_COUNTS,
    "report_document": DOCUMENT,
    "normalize_text": r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM documents",
    "text_similarity": f"""WITH {TURNS}, x AS (
  SELECT p.pair_id, p.turn, {_norm('p.text')} a, {_norm('c.text')} b FROM t p JOIN t c ON c.pair_id = p.pair_id AND c.turn = p.turn AND c.side = 'curr' WHERE p.side = 'prev')
SELECT pair_id, turn, {_sim('a', 'b')} AS similarity FROM x""",
    "number_prefix": r"""WITH raw AS (
  SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN p_name ELSE p_size || '.' || p_partkey
    || CASE p_type WHEN 'PROMO' THEN '  ' WHEN 'SMALL' THEN ' x ' ELSE ') ' END || p_name END s FROM part)
SELECT p_partkey, nullif(regexp_extract(s, '^(\d+\.\d+)', 1), '') AS number, trim(regexp_replace(s, '^\d+\.\d+\)?\s*', '')) AS stripped FROM raw""",
    "dv_changed": f"{RULE_PAIRS} SELECT p_partkey, {_dv_changed('old', 'new')} AS changed FROM rp",
    "cf_changed": f"{RULE_PAIRS} SELECT p_partkey, new_f2 IS DISTINCT FROM f2 AS changed FROM rp",
    "dv_display": f"""{RULE_PAIRS} SELECT p_partkey, CASE WHEN kind IS NULL OR kind = 'AnyValue' THEN '—'
  WHEN kind = 'List' AND p_size < 5 THEN 'List: ' || a || ' | ' || c WHEN kind = 'List' THEN 'List: ' || old_f1
  WHEN kind = 'Custom' THEN 'Custom: ' || old_f1
  ELSE CASE kind WHEN 'WholeNumber' THEN 'Whole number' WHEN 'TextLength' THEN 'Text length' ELSE kind END || ', ' || {_case('op', _OPS)} || ', '
    || CASE WHEN op = 'Between' THEN ({_serial('old_f1', 'kind')}) || ' and ' || ({_serial('f2', 'kind')}) ELSE ({_serial('old_f1', 'kind')}) END END AS shown FROM rp""",
    "cf_display": f"""{RULE_PAIRS} SELECT p_partkey, CASE WHEN cf_type IS NULL THEN '—'
  WHEN cf_type = 'CellIs' THEN {_case('cf_op', _OPS)} || ' ' || txt || CASE WHEN cf_op = 'NotBetween' THEN ' and ' || coalesce(f2, '') ELSE '' END
  WHEN cf_type = 'Expression' THEN 'Formula: ' || txt ELSE cf_type END AS shown FROM rp""",
    "serial_date": """WITH s AS (SELECT o_orderkey, o_orderdate d, o_orderstatus st, o_orderpriority pr, date_diff('day', DATE '1899-12-30', o_orderdate::DATE) n FROM orders)
SELECT o_orderkey, CASE WHEN pr = '5-LOW' THEN 'soon'
  WHEN st = 'F' THEN CASE WHEN pr = '1-URGENT' THEN '18:00:00' ELSE '00:00:00' END
  WHEN st = 'O' THEN strftime(d, '%Y-%m-%d') || CASE WHEN pr = '1-URGENT' THEN ' 18:00:00' ELSE '' END
  ELSE n || CASE WHEN pr = '1-URGENT' THEN '.75' ELSE '' END END AS shown FROM s""",
    "range_tokens": """SELECT c_custkey, CASE WHEN c_custkey > 0 THEN 'B2:F' || c_custkey || '|h' || c_custkey ELSE '' END AS good,
  CASE WHEN c_custkey > 0 THEN '' ELSE 'B2:F' || c_custkey || '|h' || c_custkey || '|' END || c_mktsegment || '|A1:' AS bad FROM customer""",
    "distinct_addresses": f"WITH {ADDRESSES} SELECT p_brand, address FROM da",
    "address_order": f"""WITH {ADDRESSES}, s AS (SELECT *, regexp_extract(address, '^[A-Z]+') col, regexp_extract(address, '[0-9]+')::INT row_num FROM da)
SELECT p_brand, address, row_num, col, CASE WHEN length(col) = 1 THEN ascii(col) - 64 ELSE 26 * (ascii(col) - 64) + ascii(col[2]) - 64 END::INT AS col_idx FROM s""",
    "base_name": "SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages",
    "escape_html": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "nonblank_rows": """WITH e AS (SELECT user_id::VARCHAR pair_id, event_id::INT row_num, CASE WHEN value < 20 THEN ' ' ELSE event_type END a, CASE WHEN value < 40 THEN '' ELSE props END b FROM events)
SELECT pair_id, row_num, 'A' AS col, a AS text FROM e WHERE trim(a) <> '' OR trim(b) <> '' UNION ALL SELECT pair_id, row_num, 'B', b FROM e WHERE trim(a) <> '' OR trim(b) <> ''""",
    "range_errors": """SELECT c_custkey::VARCHAR pair_id, 'bad ranges: ' || CASE c_nationkey % 5 WHEN 0 THEN 'bad range; A0:A2' ELSE 'ZZZ3; B99999999999' END AS error
FROM customer WHERE c_nationkey % 5 < 2""",
    "layout_errors": """SELECT c_custkey::VARCHAR pair_id, 'curr' side, CASE c_nationkey % 6 WHEN 0 THEN 'sectionRows is not a list of texts'
  WHEN 1 THEN 'chapterRows is not a list of whole numbers' WHEN 2 THEN 'config is not a JSON object'
  WHEN 3 THEN CASE WHEN c_nationkey >= 2 THEN 'first row not below section row' END WHEN 5 THEN 'format' END AS error
FROM customer WHERE c_nationkey % 6 <> 4""",
    "ingest_errors": """SELECT CASE WHEN conv_id % 7 = 0 THEN conv_id || '.xlsx' ELSE conv_id || '.prev.xlsx' END path,
  CASE WHEN conv_id % 7 = 0 THEN 'ValueError' ELSE 'BadZipFile' END error
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 = 0 OR conv_id % 5 = 0""",
    "cell_range_diff": """WITH c AS (SELECT c_custkey::VARCHAR pair_id, c_nationkey n, c_acctbal b, c_mktsegment FROM customer WHERE c_nationkey % 5 >= 2),
g AS (
  SELECT pair_id, unnest(generate_series(1, n + 2)) r, x.k FROM c, (VALUES (1), (2), (3)) x(k)
  UNION SELECT pair_id, y.r, x.k FROM c, (VALUES (2), (3)) y(r), (VALUES (2), (3), (4)) x(k)
  UNION SELECT pair_id, 9, 26 FROM c
),
d AS (
  SELECT g.*, r = 9 AND k = 26 AND n > 12 AND lower(c_mktsegment) <> c_mktsegment text_changed, r IN (2, 3) AND k IN (2, 3) AND b > 5000 dv_changed
  FROM g JOIN c USING (pair_id)
)
SELECT pair_id, chr(64 + k::INT) || r address, r::INT row_num, k::INT col_idx, CASE WHEN text_changed OR dv_changed THEN 'changed' ELSE 'unchanged' END status,
  text_changed, dv_changed, false cf_changed FROM d""",
    "range_grid": """WITH c AS (SELECT c_custkey::VARCHAR pair_id, c_nationkey + 2 n, c_name, c_mktsegment FROM customer WHERE c_nationkey % 5 >= 2),
g AS (
  SELECT pair_id, unnest(generate_series(1, n)) row_num, x.col_idx FROM c, (VALUES (1), (2), (3)) x(col_idx)
  UNION SELECT pair_id, y.row_num, x.col_idx FROM c, (VALUES (2), (3)) y(row_num), (VALUES (2), (3), (4)) x(col_idx)
  UNION SELECT pair_id, 9, 26 FROM c
)
SELECT g.pair_id, g.row_num::INT AS row_num, g.col_idx::INT AS col_idx, CASE WHEN g.row_num = 1 AND g.col_idx = 1 THEN c.c_name WHEN g.row_num = 9 AND g.col_idx = 26 THEN c.c_mktsegment END AS text
FROM g JOIN c ON c.pair_id = g.pair_id""",
    "attach_rules": f"""WITH c AS (
  SELECT p_brand pair_id, p_partkey::INT row_num, 'C' col, 3 col_idx, p_name AS text FROM part UNION ALL SELECT p_brand, p_partkey::INT, 'D', 4, p_type FROM part),
r AS (
  SELECT 'Brand#' || (s_nationkey + 1) pair_id, s_suppkey k, s_acctbal < 5000 dv, s_suppkey * 5 r1, s_suppkey * 5 + 700 r2, 3 + s_suppkey % 2 c2, s_name,
    CASE WHEN s_acctbal >= 5000 THEN 'CellIs' WHEN s_suppkey % 4 = 0 THEN 'List' ELSE 'Decimal' END ty,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey::VARCHAR END v2
  FROM supplier),
h AS (
  SELECT c.pair_id, c.row_num, c.col, c.text, max(CASE WHEN r.dv THEN r.k END) dk, max(CASE WHEN NOT r.dv THEN r.k END) ck
  FROM c LEFT JOIN r ON r.pair_id = c.pair_id AND c.row_num BETWEEN r.r1 AND r.r2 AND c.col_idx BETWEEN 3 AND r.c2 GROUP BY ALL)
SELECT h.pair_id, h.row_num, h.col, h.text, d.ty dv_type, CASE WHEN d.ty <> 'List' THEN 'Between' END dv_op, d.s_name dv_f1, nullif(d.v2, '') dv_f2,
  x.ty cf_type, CASE WHEN x.ty IS NOT NULL THEN 'Between' END cf_op, x.s_name cf_v1, x.v2 cf_v2
FROM h LEFT JOIN r d ON d.k = h.dk LEFT JOIN r x ON x.k = h.ck""",
    "layout_scan": LAYOUT_SCAN,
    "section_specs": SECTION_SPECS,
    "span_specs": f"{SPANS} SELECT pair_id, sec_ord::INT AS sec_ord, q_ord::INT AS q_ord, section_row, first_row, span, error FROM sp",
    "section_violations": f"""{SPANS} SELECT pair_id, sec_ord::INT AS sec_ord, q_ord::INT AS q_ord, 'question reaches next section' AS error
FROM sp WHERE first_row + span - 1 >= nxt""",
    "span_expand": f"""{SPANS}, e AS (SELECT pair_id, sec_ord, q_ord, unnest(generate_series(0, span - 1)) row_offset, first_row FROM sp WHERE error IS NULL),
s AS (SELECT o_custkey::VARCHAR pair_id, o_orderpriority[1]::INT * 5 row_num, min(o_orderpriority) label FROM orders GROUP BY ALL)
SELECT e.pair_id, e.sec_ord::INT AS sec_ord, e.q_ord::INT AS q_ord, e.row_offset::INT AS row_offset, (e.first_row + e.row_offset)::INT AS row_num, coalesce(s.label, '') AS label
FROM e LEFT JOIN s ON s.pair_id = e.pair_id AND s.row_num = e.first_row + e.row_offset""",
    "asof_header": """WITH h AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error')
SELECT e.event_id, h.event_id AS header_id FROM events e ASOF LEFT JOIN h ON h.user_id = e.user_id AND e.ts >= h.ts""",
    "interval_first": """WITH b AS (SELECT s_suppkey AS "key", unnest([0, 1, 2, 3]) band, s_nationkey w FROM supplier),
p AS (SELECT l_suppkey AS "key", l_quantity::INT AS "at", count(*) items FROM lineitem GROUP BY ALL)
SELECT p."key", p."at", p.items, min(b.band) AS band FROM p JOIN b ON b."key" = p."key" AND p."at" BETWEEN b.band * 10 + 5 AND b.band * 10 + 5 + b.w GROUP BY ALL""",
    "extract_control": EXTRACT_CONTROL,
    "extract_risk": f"WITH {RISK} SELECT pair_id, side, ord, section, number, text, row_num, explanation, {RULE} FROM q",
    "extract_general": f"WITH {GENERAL} SELECT * FROM qc",
    "row_labels": f"WITH {GENERAL} SELECT pair_id, side, ord, number, text, labels FROM q",
    "pair_scores": f"WITH {RISK}, {_align(9)} SELECT pair_id, n_ord, o_ord, similarity FROM m",
    "adjusted_scores": f"WITH {RISK}, {_align(9)} SELECT pair_id, n_ord, o_ord, adj FROM m",
    "match_one_to_one": f"WITH {RISK}, {_align(9)} SELECT pair_id, n_ord, o_ord FROM m",
    "second_best": f"WITH {RISK}, {_align(9)} SELECT pair_id, n_ord, second_best FROM m",
    "added_rows": f"WITH {RISK}, {_align(9)} SELECT n.pair_id, n.ord, n.number, n.text FROM n JOIN al ON al.pair_id = n.pair_id AND al.n_ord = n.ord WHERE al.o_ord IS NULL",
    "removed_rows": f"WITH {RISK}, {_align(9)} SELECT o.pair_id, o.ord, o.number, o.text FROM o JOIN al ON al.pair_id = o.pair_id AND al.o_ord = o.ord WHERE al.n_ord IS NULL",
    "question_diff": f"""{RISK_DIFF} SELECT pair_id, status, n_ord, o_ord, similarity, second_best, text_changed, number_changed, dv_changed, cf_changed, explanation_changed FROM d""",
    "diff_summary": f"""{RISK_DIFF} SELECT pair_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status <> 'added') AS compared FROM d GROUP BY pair_id""",
    "similarity_band": f"""{RISK_DIFF} SELECT pair_id, n_ord, CASE WHEN similarity >= 0.8 THEN 'green' WHEN similarity >= 0.6 THEN 'amber' ELSE 'red' END AS band,
  floor(similarity * 100 + 0.5)::INT AS pct FROM d WHERE n_ord IS NOT NULL AND o_ord IS NOT NULL""",
    "ambiguous_matches": f"""{RISK_DIFF} SELECT pair_id, n_ord, floor(second_best * 100 + 0.5)::INT AS second_pct, coalesce(similarity - second_best < 0.1::DOUBLE, false) AS ambiguous
FROM d WHERE n_ord IS NOT NULL AND o_ord IS NOT NULL""",
    "change_badges": f"""{RISK_DIFF} SELECT pair_id, n_ord, concat_ws(',', CASE WHEN text_changed THEN 'T' END, CASE WHEN number_changed THEN '#' END,
  CASE WHEN dv_changed THEN 'DV' END, CASE WHEN cf_changed THEN 'CF' END) AS badges FROM d WHERE status = 'changed'""",
    "bucket_ordinal": f"{RISK_DIFF} SELECT pair_id, status, n_ord, o_ord, row_number() OVER (PARTITION BY pair_id, status ORDER BY coalesce(n_ord, o_ord)) AS position FROM d",
    "sheet_order": f'{SHEET} SELECT "view", pair_id, status, row_num, section, number, text FROM v',
    "sheet_order_breaks": f"""{SHEET}, w AS (SELECT *, row_number() OVER k AS position, lag(section) OVER k AS above FROM v WINDOW k AS (PARTITION BY "view", pair_id ORDER BY row_num, rk, ord))
SELECT "view", pair_id, row_num, position, false AS chapter_break, position = 1 OR section IS DISTINCT FROM above AS section_break FROM w""",
    "search_rows": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'anvil brand#1')",
    "write_tables": f"""{RISK_DIFF}, s AS (
  SELECT pair_id, count(*) FILTER (status = 'added') a, count(*) FILTER (status = 'removed') r, count(*) FILTER (status = 'changed') c,
    count(*) FILTER (status = 'unchanged') u, count(*) FILTER (status <> 'added') n FROM d GROUP BY pair_id)
SELECT 'summary' AS sheet, row_number() OVER (ORDER BY pair_id) AS row_key, 'pair_id|added|removed|changed|unchanged|compared' AS header, pair_id || '|' || a || '|' || r || '|' || c || '|' || u || '|' || n AS "row" FROM s
UNION ALL SELECT 'questions', row_number() OVER (ORDER BY pair_id, status, n_ord NULLS FIRST, o_ord NULLS FIRST), 'pair_id|status|n_ord|o_ord', pair_id || '|' || status || '|' || coalesce(n_ord::VARCHAR, '') || '|' || coalesce(o_ord::VARCHAR, '') FROM d""",
    "ingest_cells": f"""WITH {RISK}, x AS (
  SELECT r.pair_id, r.side, r.row_num, c.col, c.col_idx, c.val FROM r
  CROSS JOIN LATERAL (VALUES ('B', 2, r.number), ('C', 3, r.text), ('D', 4, CASE WHEN r.row_num < 12 THEN '' END), ('E', 5, CASE WHEN r.row_num < 12 THEN r.explanation END)) c(col, col_idx, val)
  UNION ALL SELECT conv_id::VARCHAR, s.side, 1, 'C', 3, 'Conversation' FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('prev'), ('curr')) s(side))
SELECT pair_id, side, 'Risk Level Questions' AS sheet, row_num, col, col_idx, val AS text FROM x WHERE val IS NOT NULL""",
    "cell_report_document": f"""WITH x AS ({_cell_report(True)})
SELECT pair_id, status, row_number() OVER (PARTITION BY pair_id, status ORDER BY row_num, length(col), col) AS position, address, col, row_num,
  CASE WHEN status = 'changed' THEN old_value END old_value, new_value, CASE WHEN status = 'changed' THEN old_dv END old_dv, new_dv, CASE WHEN status = 'changed' THEN dv_changed END dv_changed FROM x""",
    "ingested_question_diff": f"""{RISK_DIFF} SELECT pair_id, status, n_ord, o_ord, similarity, text_changed, number_changed, dv_changed, cf_changed, explanation_changed FROM d""",
    "ingest_rules": f"""WITH {TURNS}, r AS (
  SELECT pair_id, side, 'dv' kind, turn, row_num, CASE role WHEN 'user' THEN 'List' ELSE 'WholeNumber' END "type", 'Between' op,
    CASE WHEN role = 'assistant' THEN '1' WHEN side = 'prev' THEN '"Yes,No,' || turn || '"' ELSE '"' || turn || ', No,Yes"' END v1,
    CASE role WHEN 'assistant' THEN length(text)::VARCHAR ELSE '' END v2 FROM t WHERE role IN ('user', 'assistant')
  UNION ALL
  SELECT pair_id, side, 'cf', turn, row_num, 'Expression', 'Equal', '=LEN(C' || row_num || ')>800', NULL FROM t WHERE role = 'assistant' AND length(text) > 800
)
SELECT pair_id, side, 'Risk Level Questions' AS sheet, kind, (row_number() OVER (PARTITION BY pair_id, side, kind ORDER BY turn) - 1)::INT AS rule_ord, 0 AS range_ord,
  row_num r1, 4 AS c1, row_num r2, 4 AS c2, "type", op, v1, v2 FROM r""",
    "cell_diff_value": _cell_report(False),
    "cell_diff_full": _cell_report(True),
    "cell_diff_summary": f"""WITH x AS ({_cell_report(True)}) SELECT pair_id, status, count(*) AS cells FROM x GROUP BY pair_id, status""",
    "answer_cell_diff": f"""{GENERAL_DIFF} SELECT pair_id, n_ord, o_ord, col || '[' || row_offset || ']' AS cell, old_text, new_text, true AS text_changed,
  CASE WHEN old_text IS NULL THEN 'new' WHEN new_text IS NULL THEN 'gone' END AS marker FROM ch WHERE kind = 'answer'""",
    "nested_cells": f"""WITH {GENERAL} SELECT pair_id, side, ord, kind,
  row_number() OVER (PARTITION BY pair_id, side, ord, kind ORDER BY row_offset, col_ord) AS position, row_offset, col, cell_text FROM qc""",
    "cell_change_order": f"""{GENERAL_DIFF} SELECT pair_id, n_ord, o_ord, row_number() OVER (PARTITION BY pair_id, n_ord, o_ord ORDER BY row_offset, col) AS position,
  row_offset, col, old_text, new_text, true AS text_changed FROM ch WHERE kind = 'answer'""",
    "explanation_cell_diff": f"""{GENERAL_DIFF} SELECT pair_id, n_ord, o_ord, 'G[' || row_offset || ']' AS cell, old_text, new_text, true AS text_changed,
  CASE WHEN old_text IS NULL THEN 'new' WHEN new_text IS NULL THEN 'gone' END AS marker FROM ch WHERE kind = 'explanation'""",
    "cells_changed_flag": f"{GENERAL_DIFF} SELECT * FROM fl",
    "general_question_diff": f"""{GENERAL_DIFF}, g AS (
  SELECT al.*, CASE WHEN al.n_ord IS NOT NULL AND al.o_ord IS NOT NULL THEN true END matched, n.number nn, o.number pn, fl.answer_cells_changed a, fl.explanation_cells_changed e
  FROM al LEFT JOIN n ON n.pair_id = al.pair_id AND n.ord = al.n_ord LEFT JOIN o ON o.pair_id = al.pair_id AND o.ord = al.o_ord
  LEFT JOIN fl ON fl.pair_id = al.pair_id AND fl.n_ord = al.n_ord AND fl.o_ord = al.o_ord),
h AS (SELECT pair_id, n_ord, o_ord, similarity, second_best, CASE WHEN matched THEN similarity < 1 END text_changed, CASE WHEN matched THEN nn IS DISTINCT FROM pn END number_changed,
  CASE WHEN matched THEN coalesce(a, false) END answer_cells_changed, CASE WHEN matched THEN coalesce(e, false) END explanation_cells_changed FROM g)
SELECT *, CASE WHEN o_ord IS NULL THEN 'added' WHEN n_ord IS NULL THEN 'removed' WHEN text_changed OR number_changed OR answer_cells_changed OR explanation_cells_changed THEN 'changed' ELSE 'unchanged' END AS status FROM h""",
}
