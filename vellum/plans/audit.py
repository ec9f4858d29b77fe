"""The audit: a registry of rules over the relations of many documents, and the plan that runs them together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import cite_rules as C
from vellum.operators import derive as D
from vellum.operators import format_rules as FR
from vellum.operators import issues as I
from vellum.operators import proposal_rules as P
from vellum.operators import standards as S
from vellum.operators import structure_rules as ST
from vellum.operators import text_rules as X
from vellum.operators.durable import dealt_anew


@dataclass
class Tables:
    """Relations by name; those that a source doesn't have are absent, and rules that need them don't run."""

    given: dict[str, DataFrame]
    settle: Callable[[DataFrame], DataFrame] | None = None
    known: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        if name not in self.known:
            made = DERIVED[name][1](self)
            self.known[name] = self.settle(made) if self.settle else made
        return self.known[name]

    def __contains__(self, name: str) -> bool:
        return name in self.given or name in DERIVED and all(n in self for n in DERIVED[name][0])


def uncited(t: Tables) -> DataFrame | None:
    """Paragraphs in which numbers in brackets are no citations: the reference list and the table of contents."""
    if "blocks" not in t:
        return None
    listed = t["entries"].select("doc_id", "para_index")
    return dealt_anew(listed.union(D.contents_region(t["blocks"]))) if "is_marker" in t["blocks"].columns else listed


def proposal_pairs(t: Tables) -> DataFrame:
    """(doc_id, proposal, thesis): proposals(doc_id, proposal) beside the whole text of the documents that they are of."""
    whole = t["blocks"].filter("kind = 'p'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("thesis"))
    return t["proposals"].select("doc_id", "proposal").join(whole, "doc_id")


DERIVED: dict[str, tuple[tuple[str, ...], Callable[[Tables], DataFrame]]] = {
    "entries": (("blocks",), lambda t: D.references(t["blocks"])),
    "regions": (("blocks",), lambda t: D.regions(t["blocks"])),
    "body": (("blocks",), lambda t: D.body_only(t["blocks"], t["entries"])),
    "headings": (("blocks",), lambda t: D.headings(t["blocks"])),
    "captions": (("blocks",), lambda t: D.captions(t["blocks"])),
    "citations": (("runs",), lambda t: D.citations(t["runs"], uncited(t))),
    "pairs": (("proposals", "blocks"), proposal_pairs),
    "toc": (("blocks", "runs"), lambda t: D.contents_region(t["blocks"])),
    "paras": (("blocks", "runs", "styles"), lambda t: FR.effective(D.section_of(t["blocks"]), t["runs"], t["styles"].drop("path", "sha256"))),
    "section_kinds": (("blocks", "sections"), lambda t: t["sections"].join(D.section_of(t["blocks"]).select("doc_id", "section_index", "is_front").distinct(), ["doc_id", "section_index"], "left").fillna(False, ["is_front"])),
}


@dataclass
class Rule:
    name: str
    layer: str
    needs: tuple[str, ...]
    run: Callable[[Tables, dict], DataFrame]
    optional: bool = False


RULES: list[Rule] = []


def rule(name: str, layer: str, *needs: str, optional: bool = False):
    """Registers f(tables, standards) -> issues."""
    def register(f):
        RULES.append(Rule(name, layer, needs, f, optional))
        return f

    return register


rule("page-setup", "L1", "sections")(lambda t, s: FR.page_setup(t["sections"], s))
rule("page-numbering", "L1", "section_kinds")(lambda t, s: FR.page_numbering(t["section_kinds"], s))
rule("header", "L1", "sections")(lambda t, s: FR.header(t["sections"], s))
rule("fonts", "L1", "paras")(lambda t, s: FR.fonts(t["paras"], s))
rule("style-compliance", "L1", "paras")(lambda t, s: FR.style_compliance(t["paras"], t["runs"], t.given.get("declared")))
rule("toc", "L1", "toc")(lambda t, s: FR.contents(t["blocks"].filter("kind = 'p'"), t["toc"]))
rule("cite-position", "L2", "citations")(lambda t, s: C.cite_position(t["citations"], s))
rule("cite-form", "L2", "citations")(lambda t, s: C.cite_form(t["citations"], s))
rule("cite-jump", "L2", "citations", "entries", "bookmarks")(lambda t, s: C.cite_jump(t["citations"], t["entries"], t["bookmarks"]))
rule("cite-numbering", "L2", "citations", "entries")(lambda t, s: C.cite_numbering(t["citations"], t["entries"], s))
rule("ref-coverage", "L2", "citations", "entries")(lambda t, s: C.ref_coverage(t["citations"], t["entries"]))
rule("ref-format", "L2", "entries")(lambda t, s: C.ref_format(t["entries"]))
rule("ref-duplicate", "L2", "entries")(lambda t, s: C.ref_duplicate(t["entries"]))
for _name in X.ROW_RULES:
    rule(_name, "L3", "body", optional=_name in ("cjk-spacing", "fullwidth-halfwidth"))(lambda t, s, n=_name: X.row_rules(t["body"], s, [n]))
rule("dash-density", "L3", "body")(lambda t, s: X.dash_density(t["body"], s, s.get("profile", "cjk")))
rule("heading-style", "L3", "headings")(lambda t, s: X.heading_style(t["headings"], s))
rule("term-consistency", "L3", "body", "terms", optional=True)(lambda t, s: X.term_consistency(t["body"], t["terms"]))
rule("heading-sequence", "L4", "headings")(lambda t, s: ST.heading_sequence(t["headings"]))
rule("figure-table", "L4", "captions")(lambda t, s: ST.figure_table(t["blocks"], t["captions"], s))
rule("abstract-layout", "L4", "blocks")(lambda t, s: ST.abstract_layout(t["blocks"], s))
rule("length", "L4", "regions")(lambda t, s: ST.length(t["regions"], s))


rule("prop-consistency", "L4·26", "pairs", "headings", "entries")(lambda t, s: P.proposal_issues(P.check(t["pairs"], t["headings"], t["entries"], anchors_of(t))))


ROW_RUNS = {r.name: r.run for r in RULES if r.name in X.ROW_RULES}


def anchors_of(t: Tables) -> DataFrame:
    return t["anchors"] if "anchors" in t else next(iter(t.given.values())).sparkSession.createDataFrame([], "section string, field string, tokens array<string>")


#: Attempts to find the documents at which one rule fails; beyond, whole groups of documents are reported.
ATTEMPTS = 64


def fault(docs: DataFrame, r: Rule, e: Exception) -> DataFrame:
    """The finding that a rule failed at each of docs(doc_id)."""
    reason = str(e).strip().split("\n")[0]
    return I.as_issues(docs.select("doc_id").distinct(), "audit-internal-error", r.name, r.layer, "error", F.lit(f"{type(e).__name__}: {reason[:200]}"), kind="document")


def part_of(t: Tables, bits: int, value: int) -> Tables:
    """The relations of those documents whose hash ends in these bits; tables that belong to no document stay whole."""
    here = (F.xxhash64("doc_id", F.lit("fault")).bitwiseAND(F.lit((1 << bits) - 1))) == value
    return Tables({n: df.filter(here) if "doc_id" in df.columns else df for n, df in {**t.given, **t.known}.items()})


def located(r: Rule, t: Tables, std: dict, settle: Callable[[DataFrame], DataFrame], e: Exception) -> list[DataFrame]:
    """What a rule that failed finds in the documents at which it doesn't, and a finding for each at which it does.

    Groups of documents, halved by a hash of their id, are tried until those that fail hold one document each.
    """
    out, left, tried = [], [(0, 0, e)], 0
    documents = lambda of: next(df for df in of.given.values() if "doc_id" in df.columns).select("doc_id").distinct()
    while left:
        bits, value, e = left.pop(0)
        if tried >= ATTEMPTS:
            out.append(fault(documents(part_of(t, bits, value)), r, e))
            continue
        for half in (value, value | 1 << bits):
            tried += 1
            some = part_of(t, bits + 1, half)
            try:
                out.append(settle(r.run(some, std)))
            except Exception as again:
                if documents(some).limit(2).count() == 1:
                    out.append(fault(documents(some), r, again))
                else:
                    left.append((bits + 1, half, again))
    return out


def guarded(rules: list[tuple[Rule, DataFrame]], t: Tables, std: dict, settle: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The rules' findings, worked out in one job; if that fails, in halves, until a rule that fails stands alone."""
    if not rules:
        return []
    try:
        return [settle(I.merged([p for _, p in rules]))]
    except Exception as e:
        if len(rules) == 1:
            return located(rules[0][0], t, std, settle, e)
        half = len(rules) // 2
        return guarded(rules[:half], t, std, settle) + guarded(rules[half:], t, std, settle)


def audit(tables: dict[str, DataFrame], template: str | None = None, config: str | None = None, only: tuple[str, ...] = (), optional: bool = False, ignore: DataFrame | None = None, profile: str = "cjk", settle: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """(issues, notes): all rules that the tables allow, in one plan. A rule whose plan can't be built becomes an issue.

    With `settle`, such as operators.durable.durable, each derived relation is worked out once and kept, rather than in every
    rule that reads it: the better way for a corpus. The findings are settled, too, so that a rule that fails on an executor
    is found out: it becomes an issue of the documents at which it fails, and all else stands. `only` names rules or layers. Notes say what wasn't judged: rules without their relations and standards that are unset.
    """
    std = S.for_job(template, config) | {"profile": profile}
    notes = [f"not judged: {key}" for key, v in std.items() if v is None]
    t, parts, rows = Tables(tables, settle), [], []
    for r in RULES:
        if only and r.name not in only and r.layer not in only or r.optional and not optional:
            continue
        lacking = [n for n in r.needs if n not in t]
        if lacking:
            notes.append(f"not run: {r.name} (no {', '.join(lacking)})")
            continue
        if r.name in X.ROW_RULES and r.run is ROW_RUNS[r.name]:
            rows.append(r.name)  # those of one paragraph share one pass over the body
            continue
        try:
            parts.append((r, r.run(t, std)))
        except Exception as e:  # one rule's fault is reported and doesn't end the others
            parts.append((r, fault(next(iter(tables.values())), r, e)))
    if rows:
        together = Rule("+".join(rows), "L3", ("body",), lambda t, s: X.row_rules(t["body"], s, rows))
        parts.append((together, X.row_rules(t["body"], std, rows)))
    if not parts:
        return I.as_issues(next(iter(tables.values())).limit(0), "none", "none", "L3", "info", F.lit("")), notes
    out = I.merged(guarded(parts, t, std, settle) if settle else [p for _, p in parts])
    return I.suppressed(out, ignore) if ignore is not None else out.withColumn("suppressed", F.lit(False)), notes
