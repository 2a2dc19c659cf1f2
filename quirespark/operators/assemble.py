"""The verbs: passes in their order. Order is semantics: see each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..stages import Stages
from . import citations, dedupe, folios, layout, notes, reading, toc, typography


def assemble(items: DataFrame, *, book_facts: DataFrame | None = None, decisions: DataFrame | None = None, link_index: bool = False, link_citations: bool = False, witness: DataFrame | None = None) -> dict[str, DataFrame]:
    """Items to a finished book: pages (book_id, page_index, body), nav, and every stage's accounts by name.

    1 furniture apart, running heads off, bodies joined; 2 mathematics before entry heads; 3 chapter heads made equal,
    missing ones set, lists; 4 the snapshot of texts that duplicates are judged on; 5 folios from furniture and their audit;
    6 duplicates and blank pages dropped; 7 hyphens over page ends, then reviewed decisions; 8 contents placed; 9 footnotes, then
    endnotes; 10 citations after the decisions, so that corrected words can link; 11 folio gaps filled, then the index.
    book_facts: book_id, page_index, is_native, from_pdf.
    """
    stored = Stages(items, "assemble").store
    body_items, furniture = layout.split_furniture(items)
    pages = layout.assemble_bodies(layout.strip_running_heads(body_items)).withColumn("page_index", F.col("page_index").cast("long"))
    pages = stored(toc.normalise_entry_heads(typography.normalise_math(pages)))
    pages = stored(toc.normalise_chapter_heads(pages))
    pages = stored(typography.normalise_lists(toc.promote_missing_chapters(pages)))
    texts = pages.select("book_id", "page_index", T.strip_tags(F.col("body")).alias("text"))
    numbers = stored(folios.folios_from_furniture(furniture))
    verdicts = stored(dedupe.page_verdicts(texts))
    facts = book_facts if book_facts is not None else pages.select("book_id", "page_index", F.lit(False).alias("is_native"), F.lit(False).alias("from_pdf"))
    gone = dedupe.drop_decisions(verdicts, facts).select("book_id", "page_index")
    seen = witness if witness is not None else pages.select("book_id", "page_index", F.lit(0).alias("n_words"))
    gone = gone.union(reading.blank_pages(pages, seen, gone).select("book_id", "page_index"))
    gone = stored(gone)
    kept = stored(typography.join_page_hyphens(pages.join(gone, ["book_id", "page_index"], "left_anti")))
    if decisions is not None:
        from .adjudicate import apply_decisions

        kept = stored(apply_decisions(kept, decisions).drop("applied", "stale"))
    printed = stored(toc.parse_contents(kept))
    placed = stored(toc.place_entries(toc.row_depths(printed), numbers, kept))
    linked, foot_stats = notes.link_footnotes(kept)
    kept = stored(linked.select("book_id", "page_index", "body"))
    linked, note_stats = notes.link_notes(kept)
    kept = stored(linked.select("book_id", "page_index", "body"))
    stats = {"footnotes": foot_stats, "notes": note_stats}
    if link_citations:
        linked, stats["citations"] = citations.link_citations(kept)
        kept = stored(linked.select("book_id", "page_index", "body"))
    filled = stored(folios.fill_folio_gaps(numbers, kept))
    if link_index:
        linked, stats["index"] = citations.link_index(kept, filled)
        kept = stored(linked.select("book_id", "page_index", "body"))
    heads = toc.heads_contents(kept)
    nav = placed.where("target_page is not null").select("book_id", "entry_index", "title", "target_page")
    nav = nav.union(heads.join(nav.select("book_id").distinct(), "book_id", "left_anti").select("book_id", "entry_index", "title", "target_page"))
    audit = folios.audit_folios(numbers)
    return {"pages": kept.select("book_id", "page_index", "body"), "nav": nav, "verdicts": verdicts, "dropped": gone, "folios": filled, "audit": audit} | stats
