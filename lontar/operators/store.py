"""Stored pages and documents as DataFrames: reads with their defaults, changes of state, and what a parse writes.

Changes give new DataFrames; a caller writes them where the tables live. Reads of one document are the same reads with
a filter, which reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import text as tx

from . import records

#: Error classes that say nothing about the document; kinds parsed without the gate; verdict of rejection.
TRANSIENT, NON_REGULATION, NOT_A_REGULATION = ["canceled", "deadline_exceeded", "load_error"], ["SURAT EDARAN"], "bukan_peraturan"
#: Fixed value: what is said of a node that has text without structure before it.
LOOSE_TEXT = "Teks tidak dikenali struktur; perlu tinjauan / kemungkinan sisip baris"
#: Bits of a node id that number the nodes of a document.
NODE_BITS = 20


def effective_text() -> Column:
    """Edited text of a page if there is any, else what recognition gave."""
    return F.coalesce("edited_text", "ocr_text")


def saved_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, at, text, flags and measures) with 0 for unknown measures; at is the page's place
    among the document's pages."""
    measures = [F.coalesce(c, F.lit(0)).cast(dict(pages.dtypes)[c]).alias(c) for c in ("ink_ratio", "cropped_pct", "dpi_pakai", "duration_ms")]
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    return pages.select("document_id", "page_number", at.alias("at"), effective_text().alias("text"), "is_empty", "is_truncated", *measures, "notes")


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """(document_id, texts) of the pages from first to last, in order of their number."""
    some = pages.where(F.col("page_number").between(first, last)).select("document_id", F.struct("page_number", effective_text().alias("text")).alias("p"))
    return some.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]).alias("texts"))


def page_text(pages: DataFrame, number: int) -> DataFrame:
    """(document_id, text) of one page of each document that has it."""
    return pages.where(F.col("page_number") == number).select("document_id", effective_text().alias("text"))


def lookups(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, total_pages, known_pages, text_source, classified, dpi_page1, page1_text) of every document; what is unknown
    and what is not there give the same default."""
    one = pages.where("page_number = 1").select(F.col("document_id").alias("id"), "dpi_pakai", effective_text().alias("page1_text"))
    joined = documents.join(one, "id", "left")
    return joined.select(
        "id", F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.col("total_pages").isNotNull().alias("known_pages"), F.coalesce("text_source", F.lit("")).alias("text_source"),
        F.col("classified_at").isNotNull().alias("classified"), F.coalesce("dpi_pakai", F.lit(0)).alias("dpi_page1"), "page1_text",
    )


def first_filled_page(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text) of the first page that is not empty."""
    filled = pages.where(~F.col("is_empty") & (effective_text() != ""))
    return filled.groupBy("document_id").agg(F.min(F.struct("page_number", effective_text().alias("text"))).alias("p")).select("document_id", "p.*")


def has_page(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (document_id, page_number, ...) with has: whether that page is stored."""
    known = pages.select("document_id", "page_number", F.lit(True).alias("_has")).distinct()
    return wanted.join(known, ["document_id", "page_number"], "left").withColumn("has", F.coalesce("_has", F.lit(False))).drop("_has")


def missing_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of wanted that are not stored: what is left to read after an interruption."""
    return wanted.join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, pages) for every document, 0 without any. Pages are counted before the join."""
    counted = pages.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("pages"))
    return documents.select("id").join(counted, "id", "left").select("id", F.coalesce("pages", F.lit(0).cast("long")).alias("pages"))


def claim_for_parse(documents: DataFrame, sources: DataFrame, pages: DataFrame, limit: int, workers: int = 1) -> DataFrame:
    """(id, jenis, num_pages, nth, worker) of the next documents to parse: by priority of their source, year, number and
    when recognition ended. Each goes to one of the workers, so no two claim the same."""
    waiting = documents.where("status = 'ocr_done'")
    top = records.claim(waiting, sources, "ocr_done", "ocr_done", "ocr_completed_at", limit)
    order = Window.orderBy(*records.claim_order("ocr_done", "ocr_completed_at"))
    ranked = top.withColumn("nth", F.row_number().over(order))  # at most `limit` rows
    counted = ranked.join(pages.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return counted.select("id", F.coalesce("jenis", F.lit("")).alias("jenis"), F.coalesce("n", F.lit(0).cast("long")).alias("num_pages"), "nth", ((F.col("nth") - 1) % workers).alias("worker"))


def _change(documents: DataFrame, hit: Column, **values: Column) -> DataFrame:
    return documents.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def requeue(documents: DataFrame, hit: Column, status: str) -> DataFrame:
    """documents put back to a state without a counted attempt where `hit` holds."""
    return _change(documents, hit, status=F.lit(status))


def reject(documents: DataFrame, hit: Column, reason: Column, now: Column) -> DataFrame:
    """documents found to be no regulations where `hit` holds."""
    return _change(documents, hit, status=F.lit("rejected"), is_peraturan=F.lit(False), reject_reason=F.lit(NOT_A_REGULATION), last_error=reason, classified_at=now)


def complete(documents: DataFrame, hit: Column, total_pages: Column, now: Column) -> DataFrame:
    """documents whose recognition is done where `hit` holds; their page count is overwritten."""
    return _change(documents, hit, status=F.lit("ocr_done"), total_pages=total_pages, ocr_completed_at=now)


def set_text_source(documents: DataFrame, elected: DataFrame) -> DataFrame:
    """documents with text_source from elected (id, text_source) where it has one."""
    new = elected.select("id", F.col("text_source").alias("_new"))
    return documents.join(new, "id", "left").withColumn("text_source", F.coalesce("_new", "text_source")).drop("_new")


def interrupted(documents: DataFrame) -> DataFrame:
    """documents (status, attempts, error) after recognition stopped: a transient error puts them back uncounted, any
    other counts as a failed attempt; without an error nothing changes."""
    passing = F.col("error").isin(TRANSIENT)
    failed = F.col("error").isNotNull() & ~passing
    out = F.col("attempts") + 1 >= records.MAX_ATTEMPTS
    status = F.when(passing, "downloaded").when(failed, F.when(out, "failed").otherwise("downloaded")).otherwise(F.col("status"))
    return documents.withColumns({"status": status, "attempts": F.col("attempts") + failed.cast("int")})


def parse_error(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, error) of documents (doc_id, jenis), given their cleaned lines: empty_input without lines, not_legal where
    the gate turns them down and their kind is not let through, else null."""
    return errors(gate(lines), documents)


def errors(gated: DataFrame, documents: DataFrame) -> DataFrame:
    """parse_error() from what the gate says (doc_id, legal)."""
    judged = documents.join(gated, "doc_id", "left")
    let_through = F.coalesce(F.upper(tx.strip(F.col("jenis"))).isin(NON_REGULATION), F.lit(False))
    return judged.select("doc_id", F.when(F.col("legal").isNull(), "empty_input").when(~F.col("legal") & ~let_through, "not_legal").alias("error"))


def gate(lines: DataFrame) -> DataFrame:
    """(doc_id, legal, pasal_count) from cleaned lines: an article, a dictum or an anchor of the recitals makes a document
    legal."""
    article = tx.has_article(F.col("text"))
    legal = article | (F.col("m.kind") == "diktum") | tx.has_recital(F.col("text"))
    return lines.groupBy("doc_id").agg(F.max(legal).alias("legal"), F.count_if(article).alias("pasal_count"))


def node_ids(nodes: DataFrame) -> DataFrame:
    """nodes (document_id, node_idx, parent_idx) with id and parent_id. Ids follow from document and index, so parents
    need no look-up and a repeated write gives the same ids."""
    of = lambda idx: F.shiftleft(F.col("document_id"), NODE_BITS) + idx
    checked = F.when(F.col("node_idx") < (1 << NODE_BITS), of(F.col("node_idx"))).otherwise(F.raise_error(F.lit(f"more than {1 << NODE_BITS} nodes in a document")).cast("long"))
    return nodes.withColumns({"id": checked, "parent_id": F.when(F.col("parent_idx") >= 0, of(F.col("parent_idx")))})


def insert_parse(documents: DataFrame, snapshots: DataFrame, results: DataFrame, nodes: DataFrame, flags: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a parse writes, together: documents, parse_snapshots, nodes, review_flags.

    results (document_id, status, report), nodes (document_id, node_idx, parent_idx, ...) and flags (document_id,
    node_idx, source, code, severity, message; node_idx -1 for the document). ValueError if a document was parsed
    before or is twice in results: a parse is written once."""
    twice = results.groupBy("document_id").count().where("count > 1").select("document_id")
    again = results.join(snapshots.select("document_id"), "document_id", "left_semi").select("document_id").union(twice)
    if row := again.head(1):
        raise ValueError(f"document {row[0][0]} was parsed before")
    named = node_ids(nodes)
    by_node = named.select("document_id", "node_idx", F.col("id").alias("node_id"))
    told = flags.join(by_node, ["document_id", "node_idx"], "left").select("document_id", "node_id", "source", "code", "severity", "message", F.lit(False).alias("resolved"), now.alias("created_at"))
    done = results.select(F.col("document_id").alias("id"), F.col("status").alias("_parsed"))
    parsed = documents.join(done, "id", "left")
    fresh = F.col("_parsed").isNotNull()
    parsed = parsed.withColumns({"status": F.when(fresh, "parsed").otherwise(F.col("status")), "parse_status": F.coalesce("_parsed", "parse_status"), "parsed_at": F.when(fresh, now).otherwise(F.col("parsed_at"))})
    return {"documents": parsed.drop("_parsed"), "parse_snapshots": snapshots.unionByName(results.withColumn("parsed_at", now)), "nodes": named.drop("node_idx", "parent_idx"), "review_flags": told}


def insert_relations(relations: DataFrame, found: DataFrame) -> DataFrame:
    """relations with the citations of documents appended."""
    return relations.unionByName(found.select(relations.columns))


def resolve_flags(flags: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """flags with those of notes (id, note) resolved."""
    given = notes.select("id", F.col("note").alias("_note"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    joined = flags.join(given, "id", "left")
    changed = {"resolved": F.when(hit, True).otherwise(F.col("resolved")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")), "resolved_note": F.when(hit, F.col("_note")).otherwise(F.col("resolved_note"))}
    return joined.withColumns(changed).drop("_note", "_hit")


def review_flags(issues: DataFrame, nodes: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(document_id, node_idx, source, code, severity, message) from issues (doc_id, code, message), from nodes with orphan
    text, and from answers of a model (doc_id, node_idx, about, problem, explanation), about being anchor_leak or
    orphan_review; only problems it confirms count. node_idx is -1 for a flag of the document."""
    by_rule = issues.select(F.col("doc_id").alias("document_id"), F.lit(-1).cast("long").alias("node_idx"), F.lit("diagnose").alias("source"), "code", F.lit("needs_review").alias("severity"), "message")
    loose = nodes.where("orphan is not null")
    by_node = loose.select(F.col("doc_id").alias("document_id"), "node_idx", F.lit("parser_warning").alias("source"), F.lit("NODE_WARNING").alias("code"), F.lit("needs_review").alias("severity"), F.lit(LOOSE_TEXT).alias("message"))
    found = by_rule.unionByName(by_node)
    if answers is None:
        return found
    told = answers.where("problem").select(F.col("doc_id").alias("document_id"), "node_idx", F.concat(F.lit("model_"), "about").alias("source"), F.upper("about").alias("code"), F.lit("needs_review").alias("severity"), F.col("explanation").alias("message"))
    return found.unionByName(told)


def answered_flags(found: DataFrame) -> DataFrame:
    """review_flags in one pass over flags that follow from a parse (doc_id, node_idx, source, code, message), each with
    the answer (about, explanation) of a model that confirms a problem of its node, else null."""
    flag = F.struct("source", "code", "message")
    told = F.when(F.col("answer").isNotNull(), F.struct(F.concat(F.lit("model_"), "answer.about").alias("source"), F.upper("answer.about").alias("code"), F.col("answer.explanation").alias("message")))
    each = found.select(F.col("doc_id").alias("document_id"), "node_idx", F.explode(F.array_compact(F.array(flag, told))).alias("x"))
    return each.select("document_id", "node_idx", "x.source", "x.code", F.lit("needs_review").alias("severity"), "x.message")


#: What a full reset empties, in the order of their dependence.
RESET = ["node_embeddings", "nodes", "parse_snapshots", "review_flags", "relations", "document_pages", "documents"]


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with those of a full reset emptied."""
    return {name: df.where("false") if name in RESET else df for name, df in tables.items()}


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table, by name."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    found = counts[0]
    for c in counts[1:]:
        found = found.unionAll(c)
    return found.orderBy("name")


def reparse(documents: DataFrame, hit: DataFrame, snapshots: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, snapshots and nodes after the parses of the documents in hit (id) are taken back: these wait again.
    hit comes from failed(), by_structure() or any list of ids."""
    hit = hit.select("id").distinct()
    again = documents.join(hit.withColumn("_hit", F.lit(True)), "id", "left")
    on = F.col("_hit").isNotNull()
    again = again.withColumns({"status": F.when(on, "ocr_done").otherwise(F.col("status")), "parsed_at": F.when(~on, F.col("parsed_at"))}).drop("_hit")
    gone = hit.withColumnRenamed("id", "document_id")
    return again, snapshots.join(gone, "document_id", "left_anti"), nodes.join(gone, "document_id", "left_anti")


def by_structure(documents: DataFrame, structure: str = "diktum") -> DataFrame:
    return documents.where((F.col("struktur") == structure) & (F.col("status") == "parsed")).select("id")


def by_verdict(snapshots: DataFrame, status: str = "FAIL") -> DataFrame:
    return snapshots.where(F.col("status") == status).select(F.col("document_id").alias("id"))


def delete_documents(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables (documents, and others by document_id) without the documents of gone (id); rows that hang on them go too."""
    others = gone.select(F.col("id").alias("document_id")).distinct()
    return {name: df.join(gone.select("id").distinct(), "id", "left_anti") if name == "documents" else df.join(others, "document_id", "left_anti") for name, df in tables.items()}


def delete_nodes(gone: DataFrame, nodes: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without those of gone (id), and flags whose node is gone set to none."""
    ids = gone.select(F.col("id").alias("node_id"), F.lit(True).alias("_gone")).distinct()
    kept = nodes.join(ids.select(F.col("node_id").alias("id")), "id", "left_anti")
    return kept, flags.join(ids, "node_id", "left").withColumn("node_id", F.when(F.col("_gone").isNull(), F.col("node_id"))).drop("_gone")


def edit_nodes(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes after edits (id, node_type, content; null: as it is), marked as edited; the type they had when they were
    parsed stays known."""
    new = edits.select("id", F.col("node_type").alias("_type"), F.col("content").alias("_content"), F.lit(True).alias("_hit"))
    joined = nodes.join(new, "id", "left")
    changed = {"original_node_type": F.coalesce("original_node_type", "node_type"), "is_edited": F.col("is_edited") | F.col("_hit").isNotNull()}
    return joined.withColumns(changed).withColumns({"node_type": F.coalesce("_type", "node_type"), "content": F.coalesce("_content", "content")}).drop("_type", "_content", "_hit")


def registered(known: DataFrame, batch: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """(group, registered, skipped) of a batch of registrations: how many addresses were new and how many not."""
    fresh = records.insert_new(known, batch, key, order).groupBy(group).agg(F.count("*").alias("registered"))
    seen = batch.groupBy(group).agg(F.count("*").alias("all_rows"))
    n = F.coalesce("registered", F.lit(0).cast("long"))
    return seen.join(fresh, group, "left").select(group, n.alias("registered"), (F.col("all_rows") - n).alias("skipped"))
