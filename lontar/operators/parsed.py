"""What is wanted of parsed documents, worked out on the nodes of a batch (parse.Nodes) where they are made: trees of
nodes, and the checks of lint. Each gives what the operators of nodes, tree and lint give of a table of nodes."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lontar.functions import fixed
from lontar.functions.text import _SPACE

from . import parse
from .parse import LABELS, PARTS, SEC, TYPE, TYPES, Nodes, _in, _joined, _last, _spread, _starts
from .store import LOOSE_TEXT

_LEAK = re.compile(fixed.ANCHOR_LEAK, re.ASCII)
_DIGITS = re.compile("^([0-9]+)")
#: Of issues, by code; and of sections that documents with articles lack.
MESSAGES = {
    "NODE_WARNINGS": "{} node memiliki warning (mis. teks tak terstruktur/orphan)", "NO_PASAL": "Tidak ada satupun Pasal maupun Diktum terdeteksi di batang tubuh", "PASAL_GAP": "Pasal tidak berurutan, kemungkinan hilang: {}",
    "AYAT_GAP": "Pasal {}: Ayat tidak berurutan, kemungkinan hilang: {}", "PENJELASAN_ORPHAN": "Penjelasan menyebut Pasal {} yang tidak ada di batang tubuh",
    "EMPTY_PASAL": "Pasal {} tidak memiliki teks, ayat, maupun huruf (kemungkinan gagal parse)", "ANCHOR_LEAK": 'Node [{}/{}] memuat penanda section ("{}") di tengah teksnya',
}
MISSING = {"menimbang": "Section 'Menimbang' tidak ditemukan", "mengingat": "Section 'Mengingat' tidak ditemukan", "memutuskan": "Section 'MEMUTUSKAN/Menetapkan' tidak ditemukan"}
NO_BODY = "Batang tubuh (Pasal-pasal) tidak terdeteksi"

Rows = tuple[np.ndarray, list]


class Tree:
    """Of each node: up, the place of its parent (-1: none), path, places from the root (-1: no such level), and label."""

    def __init__(self, n: Nodes):
        self.nodes, size = n, n.size
        turned = np.r_[True, (n.sec[1:] != n.sec[:-1]) | (n.doc[1:] != n.doc[:-1])] if size else np.zeros(0, bool)
        first = np.flatnonzero(turned)
        since = _spread(first, size, first)
        kind, none = n.node_type, np.full(size, -1)
        is_ = lambda *names: _in(kind, *[TYPE[x] for x in names])

        def last(name: str, *cleared: str) -> np.ndarray:
            """The last such node before each in its run of a section, if none of the others came after it."""
            at = _last(is_(name, *cleared), since)
            at = np.where(np.arange(size) > since, np.r_[-1, at[:-1]], -1) if size else at
            return np.where((at >= 0) & is_(name)[at], at, -1) if size else at

        bab, bagian, paragraf, pasal = last("bab"), last("bagian", "bab"), last("paragraf", "bab", "bagian"), last("pasal", "bab", "bagian", "paragraf")
        over = np.where(bagian >= 0, bagian, bab)
        self.up = np.select([is_("bagian"), is_("paragraf"), is_("pasal"), is_("ayat")], [bab, over, np.where(paragraf >= 0, paragraf, over), pasal], none)
        child = self.up >= 0
        levels = [(bab, ("bagian", "paragraf", "pasal", "ayat")), (bagian, ("paragraf", "pasal", "ayat")), (paragraf, ("pasal", "ayat")), (pasal, ("ayat",))]
        self.path = np.stack([*[np.where(child & is_(*kinds), at, -1) for at, kinds in levels], np.arange(size)], axis=1)
        self.depth = (self.path >= 0).sum(axis=1) - 1

    def label(self, put: Callable[[str, str], str] = lambda kind, label: label, then: Callable[[str], str] = lambda label: label) -> pa.Array:
        """Own labels, null for nodes without: put(type, label) of each different one."""
        n, names = self.nodes, list(self.nodes.lines.label_ids)
        mark = {"bab": "BAB ", "bagian": "Bagian "}
        pool = [then(put(k, mark.get(k, "") + x)) for k in LABELS for x in names]
        at = np.full(n.size, -1)
        for i, k in enumerate(LABELS):
            at = np.where((n.node_type == TYPE[k]) & (n.label[k] > 0), i * len(names) + n.label[k], at)
        return pa.array(pool, pa.string()).take(pa.array(at, mask=at < 0))

    def parents(self) -> pa.Array:
        return pa.array(np.where(self.up >= 0, self.nodes.idx[self.up], 0) if self.nodes.size else self.up, mask=self.up < 0)


def _ends(n: Nodes) -> np.ndarray:
    return np.r_[n.docs_at, n.size]


def _of(lines: DataFrame, make: Callable[[Nodes], pa.RecordBatch], schema: str) -> DataFrame:
    return parse.run(lines.where("doc_id is not null"), lambda c: make(Nodes(c.stitch())), schema)


def parents(lines: DataFrame) -> DataFrame:
    """(doc_id, node_idx, section, node_type, parent_idx, label) of nodes.parents."""

    def make(n: Nodes) -> pa.RecordBatch:
        t = Tree(n)
        return pa.RecordBatch.from_pydict({**{x: n.column(x) for x in ("doc_id", "node_idx", "section", "node_type")}, "parent_idx": t.parents(), "label": t.label()})

    return _of(lines, make, "doc_id {id}, node_idx long, section string, node_type string, parent_idx long, label string")


def cascade(lines: DataFrame, kind: str, put: Callable[[str, str], str]) -> DataFrame:
    """(doc_id, node_idx, node_type, label of `kind`) of nodes after an edit of the labels of that type to put(type,
    label): each node has that of its nearest ancestor or itself, see tree.cascade; nodes without one are left out."""

    def make(n: Nodes) -> pa.RecordBatch:
        t = Tree(n)
        near = np.full(n.size, -1)
        for level in range(t.path.shape[1]):
            at = t.path[:, level]
            near = np.where((at >= 0) & (n.node_type[at] == TYPE[kind]), at, near)
        kept = pc.if_else(pa.array((t.up < 0) & (n.node_type != TYPE[kind])), n.labels(kind), pa.scalar(None, pa.string()))
        value = pc.coalesce(t.label(put).take(pa.array(near, mask=near < 0)), kept)
        there = pc.is_valid(value)
        return pa.RecordBatch.from_pydict({x: y.filter(there) for x, y in {**{x: n.column(x) for x in ("doc_id", "node_idx", "node_type")}, kind: value}.items()})

    return _of(lines, make, f"doc_id {{id}}, node_idx long, node_type string, {kind} string")


def outline(lines: DataFrame) -> DataFrame:
    """(doc_id, outline) of tree.outline."""

    def make(n: Nodes) -> pa.RecordBatch:
        t = Tree(n)
        forms = pa.array(["  " * d + k for d in range(t.path.shape[1]) for k in TYPES])
        each = pc.binary_join_element_wise(forms.take(pa.array(t.depth * len(TYPES) + n.node_type)), t.label(), " ", null_handling="skip")
        return pa.RecordBatch.from_pydict({"doc_id": n.lines.ids_of(n.doc[n.docs_at]), "outline": _joined(each, _ends(n), "\n")})

    return _of(lines, make, "doc_id {id}, outline string")


_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
_CONTROL = re.compile("[\x00-\x1f]")


def _json(text: str) -> str:
    for a, b in _SHORT.items():
        text = text.replace(a, b)
    return _CONTROL.sub(lambda m: f"\\u{ord(m[0]):04X}", text)


def _json_array(texts: pa.Array) -> pa.Array:
    """Texts as they stand in JSON; most have nothing to mark."""
    odd = pc.match_substring_regex(texts, r'[\x00-\x1f"\\]')
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([_json(x) for x in texts.filter(odd).to_pylist()], pa.string()))


def nested(lines: DataFrame) -> DataFrame:
    """(doc_id, tree) of tree.nested. Nodes in the order of their paths are written one after the other; what is closed and
    opened between two follows from their depths."""

    def make(n: Nodes) -> pa.RecordBatch:
        t = Tree(n)
        places = np.sort(np.where(t.path < 0, parse.NONE, t.path), axis=1)
        places[places >= parse.NONE] = -1
        order = np.lexsort((*[places[:, i] for i in range(places.shape[1])][::-1], n.row))
        depth = t.depth[order]
        first = np.zeros(n.size, bool)
        first[n.docs_at] = True
        deeper = np.r_[0, depth[1:] - depth[:-1]] if n.size else depth
        most = t.path.shape[1]
        between = pa.array(["[", *["" if d > 0 else "]}" * (1 - d) + "," for d in range(-most, most + 1)]])
        lead = between.take(pa.array(np.where(first, 0, deeper + most + 1)))
        kinds = pa.array([f'{{"node_type":"{k}"' for k in TYPES]).take(pa.array(n.node_type[order]))
        label = pc.fill_null(t.label(then=lambda x: f',"label":"{_json(x)}"'), "").take(pa.array(order))
        each = pc.binary_join_element_wise(lead, kinds, label, ',"content":"', _json_array(n.content).take(pa.array(order)), '","children":[', "")
        ends = pa.array(["]}" * (d + 1) + "]" for d in range(most)]).take(pa.array(depth[_ends(n)[1:] - 1]))
        return pa.RecordBatch.from_pydict({"doc_id": n.lines.ids_of(n.doc[n.docs_at]), "tree": pc.binary_join_element_wise(_joined(each, _ends(n), ""), ends, "")})

    return _of(lines, make, "doc_id {id}, tree string")


def _sum(n: Nodes, mask: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask.astype(np.int64), n.docs_at) if n.size else np.zeros(0, np.int64)


def _statistics(n: Nodes) -> dict[str, np.ndarray]:
    body = n.sec == SEC["batang_tubuh"]
    is_ = lambda k: n.node_type == TYPE[k]
    sections = np.bitwise_or.reduceat(np.int64(1) << n.sec, n.docs_at) if n.size else np.zeros(0, np.int64)
    counts = {"total_nodes": np.ones(n.size), "bab": is_("bab"), "bagian": is_("bagian"), "paragraf": is_("paragraf"), "pasal": is_("pasal") & body, "diktum": is_("diktum") & body, "ayat": is_("ayat") & body, "item_preamble": is_("item"), "narasi": n.sec == SEC["narasi"], "node_warnings": n.loose()}
    found = {k: _sum(n, v) for k, v in counts.items()}
    return {"total_nodes": found.pop("total_nodes"), "sections_found": sum((sections >> i) & 1 for i in range(len(PARTS))), **found}


def _numbers(n: Nodes) -> np.ndarray:
    """The number that each label begins with, -1 without or beyond whole numbers."""
    value = lambda m: int(m[1]) if m and int(m[1]) < 1 << 31 else -1
    return np.array([value(_DIGITS.search(x)) for x in n.lines.label_ids], np.int64)


def _gaps(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(key, missing) of lint.gaps; values below 0 do not count."""
    keys, values = keys[values >= 0], values[values >= 0]
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    at = np.flatnonzero((keys[1:] == keys[:-1]) & (values[1:] - values[:-1] > 1))
    said = [", ".join(map(str, range(a + 1, b))) for a, b in zip(values[at].tolist(), values[at + 1].tolist())]
    starts = _starts(keys[at])
    return keys[at][starts], [", ".join(said[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(at)])]


def _article_gaps(n: Nodes) -> Rows:
    head = np.flatnonzero(_in(n.sec, SEC["judul"], SEC["penetapan"]))
    amends = pc.match_substring_regex(n.content.take(pa.array(head)), fixed.AMENDMENT).to_numpy(zero_copy_only=False)
    amended = np.zeros(len(n.lines.ids), bool)
    amended[n.doc[head[amends]]] = True
    at = (n.sec == SEC["batang_tubuh"]) & (n.node_type == TYPE["pasal"]) & ~amended[n.doc]
    docs, missing = _gaps(n.doc[at], _numbers(n)[n.label["pasal"][at]])
    return docs, [(x,) for x in missing]


def _by_article(n: Nodes, at: np.ndarray) -> np.ndarray:
    return n.doc[at] * len(n.lines.label_ids) + n.label["pasal"][at]


def _article(n: Nodes, keys: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Documents and articles of such keys."""
    names, size = list(n.lines.label_ids), len(n.lines.label_ids)
    return keys // size, [names[x] for x in (keys % size).tolist()]


def _verse_gaps(n: Nodes) -> Rows:
    at = (n.sec == SEC["batang_tubuh"]) & (n.node_type == TYPE["ayat"]) & (n.label["pasal"] > 0)
    keys, missing = _gaps(_by_article(n, at), _numbers(n)[n.label["ayat"][at]])
    docs, pasal = _article(n, keys)
    return docs, list(zip(pasal, missing))


def _unknown_articles(n: Nodes) -> Rows:
    article = (n.node_type == TYPE["pasal"]) & (n.label["pasal"] > 0)
    body, told = article & (n.sec == SEC["batang_tubuh"]), article & (n.sec == SEC["penjelasan_pasal"])
    has_body = np.zeros(len(n.lines.ids), bool)
    has_body[n.doc[body]] = True
    keys = np.unique(_by_article(n, told & has_body[n.doc]))
    docs, pasal = _article(n, keys[~np.isin(keys, _by_article(n, body))])
    return docs, [(x,) for x in pasal]


def _empty_articles(n: Nodes) -> Rows:
    at = np.flatnonzero((n.sec == SEC["batang_tubuh"]) & _in(n.node_type, TYPE["pasal"], TYPE["ayat"]) & (n.label["pasal"] > 0))
    article = n.node_type[at] == TYPE["pasal"]
    keys, inverse = np.unique(_by_article(n, at), return_inverse=True)
    full = pc.not_equal(pc.utf8_trim(n.content.take(pa.array(at)), _SPACE), "").to_numpy(zero_copy_only=False)
    has_text = np.zeros(len(keys), bool)
    has_text[inverse[article & full]] = True
    first, last_verse = np.full(len(keys), parse.NONE), np.full(len(keys), -1)
    np.minimum.at(first, inverse[article], n.idx[at][article])
    np.maximum.at(last_verse, inverse[~article], n.idx[at][~article])
    docs, pasal = _article(n, keys[(first < parse.NONE) & ~has_text & (last_verse < first)])
    return docs, [(x,) for x in pasal]


def _leaks(n: Nodes) -> tuple[np.ndarray, list]:
    """Nodes and the anchors in the midst of their texts."""
    at = np.flatnonzero(pc.match_substring_regex(n.content, fixed.ANCHOR_LEAK).to_numpy(zero_copy_only=False))
    found = [_LEAK.search(x) for x in n.content.take(pa.array(at)).to_pylist()]
    inner = np.array([m is not None and m.start() > 0 for m in found], bool)
    return at[inner], [m[0] for m in found if m is not None and m.start() > 0]


def _table(n: Nodes, docs: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": n.lines.ids_of(docs), **columns})


def _listed(lines: DataFrame, check: Callable[[Nodes], Rows], *names: str) -> DataFrame:
    def make(n: Nodes) -> pa.RecordBatch:
        docs, rows = check(n)
        return _table(n, docs, **{x: pa.array([r[i] for r in rows], pa.string()) for i, x in enumerate(names)})

    return _of(lines, make, "doc_id {id}, " + ", ".join(f"{x} string" for x in names))


def article_gaps(lines: DataFrame) -> DataFrame:
    return _listed(lines, _article_gaps, "missing")


def verse_gaps(lines: DataFrame) -> DataFrame:
    return _listed(lines, _verse_gaps, "pasal", "missing")


def unknown_articles(lines: DataFrame) -> DataFrame:
    return _listed(lines, _unknown_articles, "pasal")


def empty_articles(lines: DataFrame) -> DataFrame:
    return _listed(lines, _empty_articles, "pasal")


def leaks(lines: DataFrame) -> DataFrame:
    def make(n: Nodes) -> pa.RecordBatch:
        at, found = _leaks(n)
        take = lambda x: n.column(x).take(pa.array(at))
        return _table(n, n.doc[at], node_idx=take("node_idx"), section=take("section"), node_type=take("node_type"), found=pa.array(found, pa.string()))

    return _of(lines, make, "doc_id {id}, node_idx long, section string, node_type string, found string")


STATISTICS = ["total_nodes", "sections_found", "bab", "bagian", "paragraf", "pasal", "diktum", "ayat", "item_preamble", "narasi", "node_warnings"]


def statistics(lines: DataFrame) -> DataFrame:
    return _of(lines, lambda n: _table(n, n.doc[n.docs_at], **{k: pa.array(v, pa.int64()) for k, v in _statistics(n).items()}), "doc_id {id}, " + ", ".join(f"{x} long" for x in STATISTICS))


def _issues(n: Nodes) -> tuple[np.ndarray, list[str], list[str]]:
    """(document, code, message) of every issue."""
    b, stats, names = n.bounds, _statistics(n), n.lines.docs
    with_nodes = n.doc[n.docs_at]
    docs, codes, messages = [], [], []

    def add(code: str, of: np.ndarray, said: list[str]) -> None:
        docs.append(of)
        codes.extend([code] * len(said))
        messages.extend(said)

    for name, message in MISSING.items():
        of = names[(b[name] >= parse.NONE) & b["has_pasal"]]
        add("DOC_WARNING", of, [message] * len(of))
    of = names[~((b["body"] < parse.NONE) & (b["body"] < b["body_end"])) & ~b["narrative"]]
    add("DOC_WARNING", of, [NO_BODY] * len(of))
    warned = stats["node_warnings"] > 0
    add("NODE_WARNINGS", with_nodes[warned], [MESSAGES["NODE_WARNINGS"].format(x) for x in stats["node_warnings"][warned].tolist()])
    of = with_nodes[_nothing(stats)]
    add("NO_PASAL", of, [MESSAGES["NO_PASAL"]] * len(of))
    for code, check in (("PASAL_GAP", _article_gaps), ("AYAT_GAP", _verse_gaps), ("PENJELASAN_ORPHAN", _unknown_articles), ("EMPTY_PASAL", _empty_articles)):
        of, rows = check(n)
        add(code, of, [MESSAGES[code].format(*r) for r in rows])
    at, found = _leaks(n)
    add("ANCHOR_LEAK", n.doc[at], [MESSAGES["ANCHOR_LEAK"].format(PARTS[s], TYPES[t], x) for s, t, x in zip(n.sec[at].tolist(), n.node_type[at].tolist(), found)])
    return np.concatenate(docs), codes, messages


def _nothing(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["pasal"] == 0) & (stats["diktum"] == 0) & (stats["narasi"] == 0)


def issues(lines: DataFrame) -> DataFrame:
    """(doc_id, code, message) of lint.issues, those of sections included."""

    def make(n: Nodes) -> pa.RecordBatch:
        docs, codes, messages = _issues(n)
        return _table(n, docs, code=pa.array(codes, pa.string()), message=pa.array(messages, pa.string()))

    return _of(lines, make, "doc_id {id}, code string, message string")


def verdicts(lines: DataFrame) -> DataFrame:
    """(doc_id, status, n_issues) of lint.verdicts."""

    def make(n: Nodes) -> pa.RecordBatch:
        counts = np.bincount(_issues(n)[0], minlength=len(n.lines.ids))[n.doc[n.docs_at]]
        status = np.where(_nothing(_statistics(n)), 0, np.where(counts > 0, 1, 2))
        return _table(n, n.doc[n.docs_at], status=pa.array(["FAIL", "WARNING", "SUCCESS"]).take(pa.array(status)), n_issues=pa.array(counts, pa.int64()))

    return _of(lines, make, "doc_id {id}, status string, n_issues long")


def flags(lines: DataFrame) -> DataFrame:
    """(doc_id, node_idx, source, code, message) of the flags of store.review_flags that follow from a parse: of issues
    (node_idx -1) and of nodes with orphan text."""

    def make(n: Nodes) -> pa.RecordBatch:
        docs, codes, messages = _issues(n)
        at, by_rule = n.orphan_at, len(codes)
        return _table(
            n, np.r_[docs, n.doc[at]], node_idx=pa.array(np.r_[np.full(by_rule, -1), n.idx[at]]), source=pa.array(["diagnose"] * by_rule + ["parser_warning"] * len(at), pa.string()),
            code=pa.array(codes + ["NODE_WARNING"] * len(at), pa.string()), message=pa.array(messages + [LOOSE_TEXT] * len(at), pa.string()),
        )

    return _of(lines, make, "doc_id {id}, node_idx long, source string, code string, message string")
