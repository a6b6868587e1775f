"""SQL of the line, section and node rules, written for an engine with RE2 patterns."""

from lontar.functions import fixed

from . import corpus


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def group(column: str, pattern: str, n: int) -> str:
    return f"regexp_extract({column}, {quoted(pattern)}, {n})"


def stripped(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def ordinal(column: str) -> str:
    cases = " ".join(f"WHEN {quoted(w)} THEN {quoted(n)}" for w, n in fixed.ORDINALS.items())
    return f"(CASE lower({group(column, fixed.ordinal_pattern(), 1)}) {cases} ELSE '' END)"


def structural(column: str) -> tuple[str, str, str, str]:
    """kind, label, title and text of a line, each as a CASE."""
    c = column
    bagian, head = stripped(group(c, fixed.BAGIAN, 1)), group(c, fixed.DIKTUM, 1)
    tests = [
        ("bab", has(c, fixed.BAB)), ("paragraf", has(c, fixed.PARAGRAF)), ("pasal", has(c, fixed.PASAL)), ("ayat", has(c, fixed.AYAT)),
        ("bagian", f"({has(c, fixed.BAGIAN)} AND {ordinal(bagian)} <> '')"), ("huruf", has(c, fixed.HURUF)), ("angka", has(c, fixed.ANGKA)),
        ("diktum", f"({has(c, fixed.DIKTUM)} AND {ordinal(head)} <> '')"),
    ]
    kind = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests) + " ELSE 'none' END"
    label = f"""CASE kind WHEN 'bab' THEN upper({stripped(group(c, fixed.BAB, 1))}) WHEN 'paragraf' THEN {group(c, fixed.PARAGRAF, 1)}
      WHEN 'pasal' THEN upper(replace({group(c, fixed.PASAL, 1)}, ' ', '')) WHEN 'ayat' THEN lower(replace({group(c, fixed.AYAT, 1)}, ' ', ''))
      WHEN 'bagian' THEN {ordinal(bagian)} WHEN 'huruf' THEN lower({group(c, fixed.HURUF, 1)}) WHEN 'angka' THEN {group(c, fixed.ANGKA, 1)}
      WHEN 'diktum' THEN upper({stripped(head)}) ELSE '' END"""
    title = f"""CASE kind WHEN 'bab' THEN {stripped(group(c, fixed.BAB, 2))} WHEN 'paragraf' THEN {stripped(group(c, fixed.PARAGRAF, 2))}
      WHEN 'bagian' THEN {stripped(f"regexp_replace({bagian}, {quoted(fixed.ordinal_pattern())}, '')")} ELSE '' END"""
    text = f"""CASE kind WHEN 'ayat' THEN {stripped(group(c, fixed.AYAT, 2))} WHEN 'huruf' THEN {stripped(group(c, fixed.HURUF, 2))}
      WHEN 'angka' THEN {stripped(group(c, fixed.ANGKA, 2))} WHEN 'diktum' THEN {stripped(group(c, fixed.DIKTUM, 2))} ELSE '' END"""
    return kind, label, title, text


def fix_line(column: str, table: str, keep: str) -> str:
    """A query over `table` with its columns `keep` and text repaired."""
    return rf"""
SELECT {keep}, CASE WHEN {has("t", fixed.CODE_FENCE)} OR {has("t", fixed.TABLE_RULE)} THEN ''
  WHEN {has("u", fixed.VERSE_ONE)} THEN regexp_replace(u, {quoted(fixed.VERSE_ONE)}, '(1)')
  WHEN v <> '' THEN '(' || translate(left(v, -1), 'lIO', '110')
       || CASE WHEN {has("left(v, -1)", "[0-9]")} AND {has("right(v, 1)", "[lIO]")} THEN right(v, 1) ELSE translate(right(v, 1), 'lIO', '110') END
       || ')' || regexp_replace(u, {quoted(fixed.VERSE_MIXED)}, '')
  ELSE u END AS text
FROM (SELECT {keep}, t, u, {stripped(group("u", fixed.VERSE_MIXED, 1))} AS v
FROM (SELECT {keep}, t, {stripped(f"regexp_replace(regexp_replace(t, {quoted(fixed.HEADING)}, ''), {quoted(fixed.BOLD)}, '{chr(92)}2', 'g')")} AS u
FROM (SELECT {keep}, regexp_replace({stripped(column)}, '[ \t]{{2,}}', ' ', 'g') AS t FROM {table})))"""


def fix_anchor(table: str, keep: str) -> str:
    word = "upper(regexp_extract(text, '^[ \\t]*([A-Za-z]+)', 1))"
    near = ", ".join(f"levenshtein(w, '{a}') * 10 + {i}" for i, a in enumerate(fixed.ANCHORS))
    name = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(fixed.ANCHORS))
    return rf"""
SELECT {keep}, CASE WHEN used AND b // 10 >= 1 AND b // 10 <= CASE WHEN length(a) >= 10 THEN 2 ELSE 1 END
  THEN regexp_extract(text, '^([ \t]*)', 1) || a || regexp_replace(text, '^[ \t]*[A-Za-z]+', '') ELSE text END AS text
FROM (SELECT *, CASE b % 10 {name} END AS a
FROM (SELECT *, least({near}) AS b
FROM (SELECT {keep}, text, {word} AS w, regexp_matches(text, '^[ \t]*[A-Za-z]{{4,}}[ \t]*(:.*)?$') AS used FROM {table})))"""


def _line_ctes() -> str:
    kind, label, title, text = structural("text")
    firm = " OR ".join(["kind <> 'none'", *(has("text", p) for p in (fixed.MENIMBANG, fixed.MENGINGAT, fixed.MEMUTUSKAN, fixed.PENJELASAN))])
    plain = " OR ".join(has("text", p) for p in (fixed.PAGE_NUMBER, fixed.PAGE_LABEL, fixed.RULE_LINE, fixed.WATERMARK))
    return f"""
repaired AS ({fix_line("text", "corpus", "doc_id, page, line_no")}),
anchored AS ({fix_anchor("repaired", "doc_id, page, line_no")}),
kinds AS (SELECT *, {kind} AS kind FROM anchored),
classed AS (SELECT *, {label} AS label, {title} AS title, {text} AS rest, ({firm}) AS firm FROM kinds),
spread AS (SELECT doc_id, text, count(DISTINCT page) AS on_pages FROM classed GROUP BY ALL),
size AS (SELECT doc_id, max(page) AS n_pages FROM classed GROUP BY ALL),
counted AS (SELECT c.*, s.on_pages, z.n_pages,
    c.text <> '' AND z.n_pages >= {fixed.MIN_PAGES} AND s.on_pages >= (z.n_pages * 4 + 9) // 10 AND NOT c.firm AS boiler
  FROM classed c JOIN spread s USING (doc_id, text) JOIN size z USING (doc_id)),
bare AS (SELECT * FROM counted WHERE NOT boiler AND NOT (text <> '' AND ({plain} OR ({has("text", fixed.CATCHWORD)} AND NOT firm)))),
blanked AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM bare),
squeezed AS (SELECT * FROM blanked WHERE NOT (text = '' AND coalesce(before = '', false))),
ended AS (SELECT s.* FROM squeezed s JOIN (SELECT doc_id, max(line_no) AS last FROM squeezed WHERE text <> '' GROUP BY doc_id) e USING (doc_id) WHERE s.line_no <= e.last),
paired AS (SELECT *, lead(text) OVER w AS next_text, lead(page) OVER w AS next_page FROM ended WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
whole AS (SELECT * FROM paired WHERE NOT coalesce(next_page <> page AND strlen(text) >= {fixed.MIN_OVERLAP} AND NOT firm AND starts_with(lower(next_text), lower(text)), false)),
heads AS (SELECT *, lead(page) OVER w AS p2, lead(kind) OVER w AS k2, lead(label) OVER w AS l2 FROM whole WINDOW w AS (PARTITION BY doc_id, text = '' ORDER BY line_no)),
clean AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, page, line_no, text, kind, label, title, rest
  FROM heads WHERE NOT (text <> '' AND coalesce(p2 <> page AND kind <> 'none' AND label <> '' AND k2 = kind AND l2 = label, false)))"""


def _segment_ctes() -> str:
    anchors = {"menimbang": fixed.MENIMBANG, "mengingat": fixed.MENGINGAT, "memperhatikan": fixed.MEMPERHATIKAN, "memutuskan": fixed.MEMUTUSKAN, "penjelasan": fixed.PENJELASAN}
    found = ",\n".join(f"min(idx) FILTER ({has('text', p)} AND idx < n) AS {a}" for a, p in anchors.items())
    after = lambda at, *later: "coalesce(least(n, " + ", ".join(f"CASE WHEN {x} > {at} THEN {x} END" for x in later) + "), n)"
    arms = [
        (1, "judul", "0", "coalesce(least(menimbang, mengingat, memperhatikan, memutuskan), body)", "true"),
        (2, "menimbang", "menimbang", after("menimbang", "mengingat", "memutuskan", "body"), "true"),
        (3, "mengingat", "mengingat", after("mengingat", "memperhatikan", "memutuskan", "body"), "true"),
        (4, "memperhatikan", "memperhatikan", after("memperhatikan", "memutuskan", "body"), "true"),
        (5, "penetapan", "memutuskan", "least(CASE WHEN body > memutuskan THEN body ELSE memutuskan + 1 END, n)", "true"),
        (6, "batang_tubuh", "body", "body_end", "true"),
        (7, "narasi", "0", "body_end", "coalesce(body, menimbang, mengingat, memperhatikan, memutuskan, menetapkan) IS NULL"),
        (8, "penjelasan_umum", "CASE WHEN pasal_demi IS NOT NULL THEN CASE WHEN umum < pasal_demi THEN umum ELSE penjelasan END ELSE coalesce(umum, penjelasan) END", "coalesce(pasal_demi, n)", "penjelasan IS NOT NULL AND (pasal_demi IS NOT NULL OR umum IS NOT NULL OR told_pasal IS NULL)"),
        (9, "penjelasan_pasal", "coalesce(pasal_demi, penjelasan)", "n", "penjelasan IS NOT NULL AND (pasal_demi IS NOT NULL OR (umum IS NULL AND told_pasal IS NOT NULL))"),
        (10, "lampiran", "lampiran", "total", "lampiran IS NOT NULL"),
    ]
    union = " UNION ALL ".join(f"SELECT doc_id, {n} AS seg, '{s}' AS section, CAST({a} AS BIGINT) AS \"start\", CAST({b} AS BIGINT) AS \"end\" FROM placed WHERE {w}" for n, s, a, b, w in arms)
    return f"""
lengths AS (SELECT doc_id, count(*) AS total, min(idx) FILTER ({has("text", fixed.LAMPIRAN)}) AS lampiran FROM clean GROUP BY doc_id),
lined AS (SELECT c.*, z.total, z.lampiran, coalesce(z.lampiran, z.total) AS n FROM clean c JOIN lengths z USING (doc_id)),
wrapped AS (SELECT *, coalesce(min(CASE WHEN text = '' AND idx < n THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS blank,
    lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS nt, lead(kind) OVER (PARTITION BY doc_id ORDER BY idx) AS nk FROM lined),
turned AS (SELECT *, CASE WHEN nt <> '' AND nk = 'none' AND idx + 1 < n THEN blank ELSE idx + 1 END AS wrap FROM wrapped),
anchors AS (SELECT doc_id, any_value(n) AS n, any_value(total) AS total, any_value(lampiran) AS lampiran, {found},
    min(idx) FILTER (kind IN ('bab', 'pasal', 'diktum') AND idx < n) AS opened FROM turned GROUP BY doc_id),
decided AS (SELECT a.*, (SELECT min(t.idx) FROM turned t WHERE t.doc_id = a.doc_id AND t.idx < a.n AND t.idx >= coalesce(a.memutuskan, 0) AND {has("t.text", fixed.MENETAPKAN)}) AS menetapkan,
    greatest(menimbang, mengingat, memperhatikan) AS last_opening FROM anchors a),
told AS (SELECT t.doc_id, min(t.idx) FILTER ({has("text", fixed.UMUM)}) AS umum, min(t.idx) FILTER ({has("text", fixed.PASAL_DEMI)}) AS pasal_demi, min(t.idx) FILTER ({has("text", fixed.PASAL_ANYWHERE)}) AS told_pasal
  FROM turned t JOIN decided d ON t.doc_id = d.doc_id AND t.idx >= d.penjelasan AND t.idx < d.n GROUP BY t.doc_id),
placed AS (SELECT d.*, coalesce(d.penjelasan, d.n) AS body_end, o.umum, o.pasal_demi, o.told_pasal,
    CASE WHEN d.menetapkan IS NOT NULL THEN x.wrap WHEN d.memutuskan IS NOT NULL THEN y.wrap ELSE coalesce(d.opened, z.blank) END AS body
  FROM decided d LEFT JOIN told o USING (doc_id) LEFT JOIN turned x ON x.doc_id = d.doc_id AND x.idx = d.menetapkan
  LEFT JOIN turned y ON y.doc_id = d.doc_id AND y.idx = d.memutuskan LEFT JOIN turned z ON z.doc_id = d.doc_id AND z.idx = d.last_opening),
segments AS (SELECT * FROM ({union}) WHERE "start" < "end"),
seg_lines AS (SELECT s.doc_id, s.seg, s.section, c.idx, c.page, c.text, c.kind, c.label, c.title, c.rest
  FROM segments s JOIN clean c ON c.doc_id = s.doc_id AND c.idx >= s."start" AND c.idx < s."end")"""


def _node_ctes() -> str:
    from lontar.operators.nodes import FIELD_LINE, HEAD, VERSE_WORD

    kind, label, title, text = structural("text")
    flat, body = "('menimbang', 'mengingat', 'memperhatikan')", "('batang_tubuh', 'penjelasan_pasal')"
    run = "OVER (PARTITION BY doc_id, seg ORDER BY idx, sub ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    order = "OVER (PARTITION BY doc_id, seg ORDER BY idx, sub)"
    reg = lambda *events: "coalesce(last_value(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in events) + f" END IGNORE NULLS) {run}, '')"
    head_line = f"(section IN {flat} AND ({has('text', fixed.MENIMBANG)} OR {has('text', fixed.MENGINGAT)} OR {has('text', fixed.MEMPERHATIKAN)}))"
    labelled = "|| CASE WHEN content <> '' THEN ' ' || content ELSE '' END"
    return f"""
voiced AS (SELECT *, text = '' OR (section = 'penjelasan_umum' AND ({has("text", fixed.PENJELASAN)} OR {has("text", fixed.UMUM)})) AS silent FROM seg_lines),
freshed AS (SELECT *, coalesce(lag(silent) OVER (PARTITION BY doc_id, seg ORDER BY idx), true) AS fresh FROM voiced),
spoken AS (SELECT *, {head_line} AS head, {stripped(group("text", "^[^:]*:(.*)$", 1))} AS behind FROM freshed
  WHERE NOT silent AND NOT (section = 'penjelasan_pasal' AND {has("text", fixed.PASAL_DEMI)})),
behind AS (SELECT doc_id, seg, section, idx, page, fresh, 1 AS sub, behind AS text, false AS head, true AS item FROM spoken WHERE head AND behind <> ''),
behind_kind AS (SELECT *, {kind} AS kind FROM behind),
parts AS (SELECT doc_id, seg, section, idx, page, fresh, 0 AS sub, text, head, false AS item, kind, label, title, rest FROM spoken
  UNION ALL SELECT *, {label}, {title}, {text} FROM behind_kind),
closed AS (SELECT *, section = 'batang_tubuh' AND coalesce(bool_or({has("text", fixed.CLOSING)}) {run}, false) AS closing,
    section = 'penjelasan_pasal' AND {has("text", VERSE_WORD)} AS verse FROM parts),
events AS (SELECT * REPLACE (CASE WHEN verse THEN lower(replace({group("text", VERSE_WORD, 1)}, ' ', '')) ELSE label END AS label),
    CASE WHEN verse THEN {stripped(group("text", VERSE_WORD, 2))} ELSE rest END AS content,
    CASE WHEN section = 'batang_tubuh' AND NOT closing THEN kind WHEN verse THEN 'ayat'
      WHEN section = 'penjelasan_pasal' AND kind IN ('pasal', 'ayat', 'huruf', 'angka') THEN kind ELSE 'none' END AS ev FROM closed),
registers AS (SELECT *,
    {reg(("ev = 'bab'", "'BAB ' || label"))} AS bab, {reg(("ev = 'bagian'", "'Bagian ' || label"), ("ev = 'bab'", "''"))} AS bagian,
    {reg(("ev = 'paragraf'", "label"), ("ev IN ('bab', 'bagian')", "''"))} AS paragraf,
    {reg(("ev = 'pasal'", "label"), ("ev IN ('bab', 'bagian', 'paragraf', 'diktum')", "''"))} AS pasal,
    {reg(("ev = 'diktum'", "label"), ("ev IN ('bab', 'bagian', 'paragraf', 'pasal')", "''"))} AS diktum,
    {reg(("ev = 'ayat'", "label"), ("ev IN ('bab', 'bagian', 'paragraf', 'pasal', 'diktum')", "''"))} AS ayat FROM events),
folding AS (SELECT *, ev = 'huruf' AND (pasal <> '' OR diktum <> '') AS fold_huruf FROM registers),
lettered AS (SELECT *, {reg(("fold_huruf", "label"), ("ev IN ('bab', 'bagian', 'paragraf', 'pasal', 'diktum', 'ayat')", "''"))} AS letter FROM folding),
titled AS (SELECT *, ev = 'angka' AND letter <> '' AS fold_angka, {has("text", FIELD_LINE)} AS field, {has("text", HEAD)} AS numbered_head, kind IN ('huruf', 'angka') AS numbered,
    CASE WHEN contains(upper(text), 'RAHMAT TUHAN') OR (contains(upper(text), 'PRESIDEN') AND contains(upper(text), 'REPUBLIK INDONESIA') AND strlen(text) < 60)
      OR starts_with(upper(text), 'DENGAN ') THEN 'pembukaan' ELSE 'judul' END AS title_type FROM lettered),
turns AS (SELECT *, row_number() {order} = 1 AS first, coalesce(lag(title_type) {order} <> title_type OR lag(field) {order}, true) AS turn FROM titled),
typed AS (SELECT *, CASE WHEN section = 'judul' AND (fresh OR field OR turn) THEN title_type WHEN section IN {flat} AND head THEN 'section_header'
    WHEN section IN {flat} AND (item OR numbered) THEN 'item'
    WHEN section = 'penetapan' AND ({has("text", fixed.MEMUTUSKAN)} OR {has("text", fixed.MENETAPKAN)} OR first) THEN 'penetapan'
    WHEN section IN {body} AND ev IN ('bab', 'bagian', 'paragraf', 'pasal', 'ayat', 'diktum') THEN ev
    WHEN closing AND (fresh OR {has("text", fixed.CLOSING)}) THEN 'paragraf_isi' WHEN section = 'narasi' AND numbered THEN 'item'
    WHEN section = 'narasi' AND (fresh OR first) THEN 'paragraf_isi'
    WHEN section IN ('penjelasan_umum', 'lampiran') AND (numbered_head OR fresh OR first) THEN 'paragraf_isi' END AS node_type FROM turns),
pieces AS (SELECT *, sum((node_type IS NOT NULL)::BIGINT) {run} AS node_no,
    CASE WHEN node_type IN ('bab', 'bagian', 'paragraf') THEN title WHEN node_type = 'pasal' THEN '' WHEN node_type IN ('ayat', 'diktum') THEN content
      WHEN node_type = 'item' THEN CASE WHEN numbered THEN rest ELSE text END
      WHEN node_type IS NOT NULL AND section = 'penjelasan_umum' AND numbered_head THEN {group("text", HEAD, 2)}
      WHEN fold_huruf THEN label || '.' {labelled} WHEN fold_angka THEN '(' || label || ')' {labelled} ELSE text END AS piece,
    CASE WHEN fold_huruf OR fold_angka THEN chr(10) ELSE ' ' END AS between_ FROM typed),
joined AS (SELECT doc_id, seg, node_no, coalesce(substr(string_agg(between_ || piece, '' ORDER BY idx, sub) FILTER (piece <> ''), 2), '') AS content,
    string_agg(text, chr(10) ORDER BY idx, sub) AS loose, min(page) AS start_page, max(page) AS end_page FROM pieces GROUP BY ALL),
opening AS (SELECT doc_id, seg, node_no, CASE WHEN closing THEN 'penutup' ELSE section END AS section, node_type, kind, label,
    section IN {body} AND NOT closing AS bodied, bab, bagian, paragraf, pasal, ayat, diktum FROM pieces WHERE node_type IS NOT NULL),
held AS (SELECT j.*, o.section, o.node_type, o.kind, o.label, o.bodied, o.bab, o.bagian, o.paragraf, o.pasal, o.ayat, o.diktum,
    max(CASE WHEN j.node_no = 0 THEN j.loose END) OVER s AS before, max(CASE WHEN j.node_no = 1 THEN o.section END) OVER s AS first_section, max(j.node_no) OVER s AS last_no
  FROM joined j LEFT JOIN opening o USING (doc_id, seg, node_no) WINDOW s AS (PARTITION BY j.doc_id, j.seg)),
nodes AS (SELECT doc_id, row_number() OVER w - 1 AS node_idx, (row_number() OVER w) * 1000 AS doc_order, section, node_type,
    CASE WHEN bodied THEN nullif(bab, '') END AS bab, CASE WHEN bodied THEN nullif(bagian, '') END AS bagian, CASE WHEN bodied THEN nullif(paragraf, '') END AS paragraf,
    CASE WHEN bodied THEN nullif(pasal, '') END AS pasal, CASE WHEN bodied THEN nullif(ayat, '') END AS ayat, CASE WHEN bodied THEN nullif(diktum, '') END AS diktum,
    CASE WHEN node_type = 'item' AND kind = 'huruf' THEN label END AS huruf, CASE WHEN node_type = 'item' AND kind = 'angka' THEN label END AS angka,
    content, start_page, end_page, CASE WHEN node_no = CASE WHEN first_section = 'penutup' THEN last_no ELSE 1 END THEN before END AS orphan,
    node_type IN ('pasal', 'ayat', 'diktum') AND section = 'batang_tubuh' AS is_dictum,
    node_type IN ('judul', 'pembukaan', 'penetapan', 'bab', 'bagian', 'paragraf', 'section_header') OR (node_type = 'paragraf_isi' AND section = 'penutup') AS is_title,
    section = 'lampiran' AS is_appendix
  FROM held WHERE node_no > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY seg, node_no))"""


def lines(select: str) -> str:
    return f"WITH {corpus.sql()}, {_line_ctes()} {select}"


def segments(select: str) -> str:
    return f"WITH {corpus.sql()}, {_line_ctes()}, {_segment_ctes()} {select}"


def nodes(select: str, more: str = "") -> str:
    return f"WITH {corpus.sql()}, {_line_ctes()}, {_segment_ctes()}, {_node_ctes()}{more} {select}"
