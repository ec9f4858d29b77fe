"""Repair: a plan from issues, a guard, ordered idempotent edits with a journal, a ledger, and versions to go back to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.durable import dealt_anew, durable

IN_PLACE = ("cite.superscript", "cite.size", "run.clear_size", "cite.link", "cite.rewrite", "cite.move_before_punct", "run.font", "para.style", "para.border")
STRUCTURAL = ("para.delete", "para.merge_into", "para.insert_after")
FIRST = ("ref.bookmark",)
ACTIONS = FIRST + IN_PLACE + STRUCTURAL
KEEP = 12


def plan(issues: DataFrame, everything: bool = False) -> DataFrame:
    """Issues with an action as plan items: enabled if they can't be suppressed, are errors, or everything is wanted."""
    enabled = ~F.col("suppressible") | (F.col("severity") == "error") | F.lit(everything)
    return issues.filter("action is not null").select("doc_id", "issue_key", "id", "rule", "loc_index", "action", "params", enabled.alias("enabled"))


def in_plan_order(items: DataFrame) -> DataFrame:
    """Plan items as a person reads them, each document's together: enabled ones first."""
    return items.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("enabled"), "rule", "issue_key")


def toggled(items: DataFrame, toggles: DataFrame) -> DataFrame:
    """items with a person's choices, toggles(issue_key, enabled)."""
    own = toggles.select("issue_key", F.col("enabled").alias("chosen"))
    return items.join(own, "issue_key", "left").withColumn("enabled", F.coalesce("chosen", "enabled")).drop("chosen")


def with_params(items: DataFrame, issues: DataFrame) -> DataFrame:
    """items(issue_key, ..) with action and params from the audit; stale: the audit has no such issue any more."""
    known = issues.select("issue_key", "action", "params").dropDuplicates(["issue_key"]).withColumn("known", F.lit(True))
    return items.drop("action", "params").join(known, "issue_key", "left").withColumn("stale", F.col("known").isNull()).drop("known")


def guard(items: DataFrame, headers: DataFrame, documents: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, reason) for every reason not to run a plan: no document, another hash, unknown actions; missing hash only warns.

    headers(doc_id, sha256) come with the plan, documents(doc_id, sha256) are what is there now, and may have the flag locked.
    Unless strict, another hash only warns, too. What begins with `warn` stops nothing.
    """
    there = documents.select("doc_id", F.col("sha256").alias("now"), (F.col("locked") if "locked" in documents.columns else F.lit(False)).alias("locked")).withColumn("there", F.lit(True))
    both = headers.join(there, "doc_id", "left")
    changed = "changed document" if strict else "warn: changed document"
    reason = F.when(F.col("there").isNull(), "missing document").when(F.col("locked"), "locked document").when(F.col("sha256").isNull(), "warn: no hash").when(F.col("sha256") != F.col("now"), changed)
    out = both.select("doc_id", reason.alias("reason")).filter("reason is not null")
    unknown = items.filter(~F.col("action").isin(*ACTIONS)).select("doc_id", F.concat(F.lit("unknown action: "), "action").alias("reason")).distinct()
    return out.unionByName(unknown)


def counts(items: DataFrame) -> DataFrame:
    """(doc_id, enabled, items): how much of each document's plan is switched on."""
    return items.groupBy("doc_id").agg(F.count_if("enabled").alias("enabled"), F.count(F.lit(1)).alias("items"))


def phase(action: Column | str = "action") -> Column:
    a = T.col(action)
    return F.when(a.isin(*FIRST), 0).when(a.isin(*STRUCTURAL), 2).otherwise(1)


def ordered(items: DataFrame) -> DataFrame:
    """Enabled items with their step: bookmarks, edits in place, structural edits; from the document's end to its start."""
    w = Window.partitionBy("doc_id").orderBy(phase(), F.desc(F.coalesce("loc_index", F.lit(0))), "issue_key")
    return items.filter("enabled").withColumn("step", F.row_number().over(w))


def pending(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items that the ledger(doc_id, issue_key, result_sha) doesn't have for the document as it is: items(.., sha256)."""
    done = ledger.select("doc_id", "issue_key", F.col("result_sha").alias("sha256")).distinct()
    return items.join(done, ["doc_id", "issue_key", "sha256"], "left_anti")


def kept_snapshots(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest versions of each document: snapshots(doc_id, stamp, dup_no, ..)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("stamp"), F.desc("dup_no"))
    return snapshots.withColumn("k", F.dense_rank().over(w)).filter(F.col("k") <= keep).drop("k")


def rollback(snapshots: DataFrame, current: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """The version of each document at that stamp, and the snapshots with the current state appended as pre-restore.

    A version may have many rows (a row for each part of a document); all of the last one at the stamp come back.
    """
    chosen = snapshots.filter(F.col("stamp") == stamp)
    w = Window.partitionBy("doc_id").orderBy(F.desc("dup_no"))
    version = chosen.withColumn("k", F.dense_rank().over(w)).filter("k = 1").drop("k")
    backup = current.withColumn("stamp", F.concat(F.lit(stamp), F.lit("-pre-restore"))).withColumn("dup_no", F.lit(0))
    return version, snapshots.unionByName(backup, allowMissingColumns=True)


def listed(snapshots: DataFrame) -> DataFrame:
    """(doc_id, stamp, dup_no, parts): the versions that there are, newest first within a document."""
    out = snapshots.groupBy("doc_id", "stamp", "dup_no").agg(F.count(F.lit(1)).alias("parts"))
    return out.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("stamp"), F.desc("dup_no"))


def relocated(locators: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(key, doc_id, para_index, how): where a locator's paragraph is now, or how 'gone'.

    locators(key, doc_id, hint, fp, text); paragraphs(doc_id, para_index, text). In order: same place with the same
    fingerprint, the only paragraph with it, the nearest of several (ambiguous), the only one with the text's first 30
    characters, the only one that holds the whole text. All but the last are equi-joins on hashes or prefixes, ranked; the
    last looks only at documents of locators that are still without a place.
    """
    now = paragraphs.select("doc_id", "para_index", T.fingerprint("text").alias("fp"), F.substring(T.strip("text"), 1, 30).alias("prefix"), T.strip("text").alias("full"))
    same = locators.join(now.select("doc_id", "para_index", "fp"), ["doc_id", "fp"]).select("key", "doc_id", "para_index", "hint")
    w = Window.partitionBy("key", "doc_id")
    same = same.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("d", F.abs(F.col("para_index") - F.col("hint")))
    by_fp = same.select("key", "doc_id", "para_index", F.when(F.col("d") == 0, 0).when(F.col("n") == 1, 1).otherwise(2).alias("p"), "d")
    starts = locators.withColumn("prefix", F.substring(T.strip("text"), 1, 30)).filter("prefix <> ''").join(now.select("doc_id", "para_index", "prefix"), ["doc_id", "prefix"])
    by_start = starts.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("key", "doc_id", "para_index", F.lit(3).alias("p"), F.lit(0).alias("d"))
    placed = dealt_anew(by_fp.unionByName(by_start)).groupBy("key", "doc_id").agg(F.min(F.struct("p", "d", "para_index")).alias("b"))
    known = locators.join(placed, ["key", "doc_id"], "left")
    lost = known.filter("b is null").withColumn("want", T.strip("text")).filter("want <> ''")
    holds = lost.select("key", "doc_id", "want").join(now.select("doc_id", "para_index", "full"), "doc_id").filter(F.contains("full", "want")).withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1")
    out = known.join(holds.select("key", "doc_id", F.col("para_index").alias("holder")), ["key", "doc_id"], "left")
    how = F.when(F.col("holder").isNotNull(), "whole").when(F.col("b").isNull(), "gone").when(F.col("b.p") == 0, "same place").when(F.col("b.p") == 1, "unique").when(F.col("b.p") == 2, "ambiguous").otherwise("prefix")
    return out.select("key", "doc_id", F.coalesce("b.para_index", "holder").alias("para_index"), how.alias("how"))


def relocated_runs(locators: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, doc_id, para_index, run_ord): the run of a paragraph that was found, by its text and how often that came before.

    locators(key, doc_id, para_index, run_text, nth); runs(doc_id, para_index, run_ord, text). Null if there is none.
    """
    w = Window.partitionBy("doc_id", "para_index", "text").orderBy("run_ord")
    nth = runs.select("doc_id", "para_index", F.col("text").alias("run_text"), "run_ord", (F.row_number().over(w) - 1).alias("nth"))
    return locators.join(nth, ["doc_id", "para_index", "run_text", "nth"], "left").select("key", "doc_id", "para_index", "run_ord")


def locators(paragraphs: DataFrame) -> DataFrame:
    """(key, doc_id, hint, fp, text) for paragraphs(key, doc_id, para_index, text): what relocated() finds them again by."""
    return paragraphs.select("key", "doc_id", F.col("para_index").alias("hint"), T.fingerprint("text").alias("fp"), "text")


def refreshed(places: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Locators after an edit: hint, fingerprint and text of the paragraph that each is at now; those without one as they were."""
    now = relocated(places, paragraphs).filter("how not in ('gone', 'ambiguous')").select("key", "doc_id", F.col("para_index").alias("at"))
    text = paragraphs.select("doc_id", F.col("para_index").alias("at"), F.col("text").alias("now"))
    both = places.join(now, ["key", "doc_id"], "left").join(text, ["doc_id", "at"], "left")
    return both.select("key", "doc_id", F.coalesce("at", "hint").alias("hint"), F.when(F.col("now").isNotNull(), T.fingerprint("now")).otherwise(F.col("fp")).alias("fp"), F.coalesce("now", "text").alias("text"))


#: A document's parts, a row each: paragraphs, runs, bookmarks and, after an edit, the journal's entries.
PARTS = (
    "kind string, doc_id long, para_index int, run_ord int, text string, superscript boolean, anchor string, link_kind string, size_pt double, font_ea string, font_ascii string, bold boolean, "
    "style_name string, border string, name string, step int, issue_key string, action string, status string"
)
_FIELDS = [c.split() for c in PARTS.split(", ")]
_RUN = ("text", "superscript", "anchor", "link_kind", "size_pt", "font_ea", "font_ascii", "bold")


def parts_of(runs: DataFrame, paragraphs: DataFrame | None = None, bookmarks: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Relations of documents as one of PARTS; columns that a relation doesn't have are null. A header's para_index is its section."""
    out = None
    for kind, rows in (("run", runs), ("para", paragraphs), ("bookmark", bookmarks), ("header", headers)):
        if rows is None:
            continue
        row = rows.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in rows.columns and not (kind == "para" and c == "text") else F.lit(None)).cast(t).alias(c) for c, t in _FIELDS[1:]])
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class Paragraph:
    index: int | None
    style: str | None = None
    border: str | None = None
    listed: bool = False
    runs: list[dict] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parts: list = field(default_factory=list)  # elements of a file, where there is one


class Failed(Exception):
    pass


def halves(size: str) -> float:
    """A size in points as files hold it, in half points."""
    return round(2 * float(size)) / 2


class Draft:
    """One document while it is edited. Items name paragraphs by the numbers that they had at first."""

    def __init__(self, rows: list[dict]):
        found = {i: Paragraph(i) for i in sorted({r["para_index"] for r in rows if r["para_index"] is not None and r["kind"] != "header"})}
        self.knows_names = False
        self.headers = {r["para_index"]: r["border"] for r in rows if r["kind"] == "header"}
        for r in sorted(rows, key=lambda r: (r["run_ord"] is not None, r["run_ord"] or 0)):
            p = found.get(r["para_index"])
            if r["kind"] == "run":
                p.runs.append({c: r[c] for c in _RUN})
            elif r["kind"] == "para":
                p.style, p.border, p.listed = r["style_name"], r["border"], True
            elif r["kind"] == "bookmark" and p is not None:
                p.names.append(r["name"])
                self.knows_names = True
        self.paragraphs, self.of = list(found.values()), found

    def at(self, index) -> Paragraph:
        if index is None or index not in self.of:
            raise Failed("no such paragraph")
        return self.of[index]

    def run(self, index, params: dict) -> list[dict]:
        p = self.at(index)
        if "run_ord" not in params:
            return p.runs
        k = int(params["run_ord"])
        if not 0 <= k < len(p.runs):
            raise Failed("no such run")
        return [p.runs[k]]

    def put(self, targets: list[dict], **values) -> bool:
        """Sets values; whether any was another before."""
        changed = any(r[c] != v for r in targets for c, v in values.items())
        for r in targets:
            r.update(values)
        return changed

    def apply(self, action: str, index, params: dict) -> bool:
        """Whether the action changed anything."""
        if action not in ACTIONS:
            raise Failed("unknown action")
        return getattr(self, action.replace(".", "_"))(index, params)

    def cite_superscript(self, index, params):
        return self.put(self.run(index, params), superscript=params.get("on", "true") == "true")

    def cite_size(self, index, params):
        return self.put(self.run(index, params), size_pt=halves(params["size"]))

    def run_clear_size(self, index, params):
        return self.put(self.run(index, params), size_pt=None)

    def cite_rewrite(self, index, params):
        return self.put(self.run(index, params), text=params["text"])

    def cite_link(self, index, params):
        anchor, kind = params.get("anchor"), params.get("kind", "hyperlink")
        if kind == "none" or not anchor:
            return self.put(self.run(index, params), anchor=None, link_kind=None)
        if self.knows_names and not any(anchor in p.names for p in self.paragraphs):
            raise Failed("no such bookmark")
        return self.put(self.run(index, params), anchor=anchor, link_kind=kind)

    def run_font(self, index, params):
        given = {"font_ea": params.get("font"), "font_ascii": params.get("ascii"), "size_pt": halves(params["size"]) if "size" in params else None, "bold": params["bold"] == "true" if "bold" in params else None}
        if not (given := {c: v for c, v in given.items() if v is not None}):
            raise Failed("no font")
        return self.put(self.run(index, params), **given)

    def cite_move_before_punct(self, index, params):
        p = self.at(index)
        k = int(params["run_ord"]) if "run_ord" in params else 0
        if not 0 <= k < len(p.runs):
            raise Failed("no such run")
        mark = (p.runs[k - 1]["text"] or "")[-1:] if k else ""
        if not mark or mark not in params.get("punct", T.PUNCT_BEFORE):
            return False
        p.runs[k - 1]["text"] = p.runs[k - 1]["text"][:-1]
        p.runs.insert(k + 1, {**p.runs[k - 1], "text": mark})
        return True

    def para_style(self, index, params):
        p = self.at(index)
        before, p.style, p.listed = p.style, params["style"], True
        return before != p.style

    def para_border(self, index, params):
        """A border of a paragraph, or with part = header, of the header of section `index`."""
        header = params.get("part") == "header"
        p = None if header else self.at(index)
        before = self.headers.get(index) if header else p.border
        edges = dict(x.split("=", 1) for x in (before or "").split(";") if x)
        edges[params.get("edge", "bottom")] = ",".join((params.get("val", "single"), params.get("size", "6")))
        border = ";".join(f"{e}={edges[e]}" for e in ("top", "left", "bottom", "right", "between", "bar") if e in edges)
        if header:
            self.headers[index] = border
        else:
            p.border, p.listed = border, True
        return before != border

    def ref_bookmark(self, index, params):
        p, name = self.at(index), params["name"]
        if name in p.names:
            return False
        for other in self.paragraphs:  # a name stands once in a document
            if name in other.names:
                other.names.remove(name)
        p.names.append(name)
        return True

    def para_delete(self, index, params):
        p = self.at(index)
        self.paragraphs.remove(p)
        del self.of[index]
        return True

    def para_merge_into(self, index, params):
        p = self.at(index)
        at = self.paragraphs.index(p)
        if "target" in params:
            into = self.at(int(params["target"]))
        elif at:
            into = self.paragraphs[at - 1]
        else:
            raise Failed("no paragraph before")
        if into is p:
            return False
        first = at < self.paragraphs.index(into)
        into.runs = p.runs + into.runs if first else into.runs + p.runs
        into.names = p.names + into.names if first else into.names + p.names
        into.parts = p.parts + into.parts if first else into.parts + p.parts
        return self.para_delete(index, params)

    def para_insert_after(self, index, params):
        new = Paragraph(None, params.get("style"), None, "style" in params)
        new.runs.append({c: None for c in _RUN} | {"text": params.get("text", ""), "superscript": False})
        self.paragraphs.insert(self.paragraphs.index(self.at(index)) + 1, new)
        return True

    def rows(self, doc_id, gone: list[int]) -> Iterator[dict]:
        """PARTS rows. Paragraphs are numbered as before, less those that went, and with those that came."""
        for section, border in sorted(self.headers.items()):
            yield {"kind": "header", "para_index": section, "border": border}
        shift = 0
        last = None
        gone = sorted(gone)
        for p in self.paragraphs:
            if p.index is None:
                shift += 1
                number = (last or 0) + 1
            else:
                number = p.index + shift - sum(g < p.index for g in gone)
            last = number
            if p.listed:
                yield {"kind": "para", "para_index": number, "style_name": p.style, "border": p.border}
            for k, r in enumerate(p.runs):
                yield {"kind": "run", "para_index": number, "run_ord": k, **r}
            for name in p.names:
                yield {"kind": "bookmark", "para_index": number, "name": name}


def plain(value):
    """None for what pandas makes of a null."""
    return None if value is None or value is pd.NA or value != value else value


def stepped(draft: Draft, steps: list[dict]) -> list[dict]:
    """The journal's PARTS rows of a document's items in order. An item that fails changes nothing and doesn't stop the rest."""
    journal = []
    for item in sorted(steps, key=lambda s: s["step"]):
        params = dict(item["params"]) if item["params"] is not None else {}
        try:
            changed = draft.apply(item["action"], None if item["loc_index"] is None else int(item["loc_index"]), params)
            status = "applied" if changed else "skipped"
        except Failed as e:
            status = f"failed: {e}"
        except (KeyError, ValueError, TypeError) as e:
            status = f"failed: {type(e).__name__}"
        journal.append({"kind": "journal", "step": int(item["step"]), "issue_key": item["issue_key"], "action": item["action"], "para_index": item["loc_index"], "status": status})
    return journal


def folded(rows: list[dict], steps: list[dict]) -> list[dict]:
    """PARTS rows of one document after its items, and the journal's."""
    draft = Draft(rows)
    known = set(draft.of)
    journal = stepped(draft, steps)
    doc_id = (rows or steps)[0]["doc_id"]
    return [{"doc_id": doc_id, **r} for r in (*draft.rows(doc_id, list(known - set(draft.of))), *journal)]


def edited(parts: DataFrame, items: DataFrame) -> DataFrame:
    """PARTS after the enabled items, in their order, document by document, with the journal's entries among them.

    A document's edits are a fold, as structural ones shift paragraphs, so its parts and items come together by one shuffle,
    and a task holds one document at a time.
    """
    names, whole = [c for c, _ in _FIELDS], {c for c, t in _FIELDS if t == "int"}
    null = {c: F.lit(None).cast(t).alias(c) for c, t in _FIELDS}
    given = {"kind": F.lit("item").alias("kind"), "doc_id": F.col("doc_id").cast("long").alias("doc_id"), "para_index": F.col("loc_index").cast("int").alias("para_index"), "step": "step", "issue_key": "issue_key", "action": "action"}
    steps = ordered(items).select(*[given.get(c, null[c]) for c in names], "params")
    rows = parts.select(*names, F.lit(None).cast("map<string,string>").alias("params")).unionByName(steps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, steps_, at = [], [], [], None

        def done() -> None:
            out.extend([r.get(c) for c in names] for r in folded(held, steps_))
            held.clear()
            steps_.clear()

        for batch in batches:
            columns = [[None if (v := plain(x)) is None else int(v) for x in batch[c].tolist()] if c in whole else [plain(x) for x in batch[c].tolist()] for c in names]
            for *values, params in zip(*columns, batch["params"].tolist(), strict=True):
                row = dict(zip(names, values, strict=True))
                if (held or steps_) and row["doc_id"] != at:
                    done()
                at = row["doc_id"]
                if row["kind"] == "item":
                    steps_.append({**row, "loc_index": row["para_index"], "params": dict(params) if params is not None else None})
                else:
                    held.append(row)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out.clear()
        if held or steps_:
            done()
        yield pd.DataFrame(out, columns=names, dtype=object)

    return dealt_anew(rows).sortWithinPartitions("doc_id").mapInPandas(run, PARTS)


def of_kind(parts: DataFrame, kind: str) -> DataFrame:
    columns = {
        "run": ("doc_id", "para_index", "run_ord", *_RUN), "para": ("doc_id", "para_index", "style_name", "border"), "bookmark": ("doc_id", "para_index", "name"),
        "header": ("doc_id", "para_index", "border"), "journal": ("doc_id", "step", "issue_key", "action", "status"),
    }[kind]
    return parts.filter(F.col("kind") == kind).select(*columns)


def apply_plan(runs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, journal) after a plan's enabled items, of one fold. apply() is the guarded way."""
    out = durable(edited(parts_of(runs), items))
    return of_kind(out, "run"), of_kind(out, "journal")


def run_hash(runs: DataFrame) -> DataFrame:
    return state_hash(parts_of(runs))


def state_hash(parts: DataFrame) -> DataFrame:
    """(doc_id, sha256) of each document's parts, whichever order they come in."""
    rows = parts.filter("kind <> 'journal'").select("doc_id", F.struct(*[c for c, _ in _FIELDS if c not in ("doc_id", "step", "issue_key", "action", "status")]).alias("row"))
    return dealt_anew(rows).groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("row"))), 256).alias("sha256"))


@dataclass
class Applied:
    """What an apply did: parts as they are now, the journal, the ledger, the snapshots, and why plans were refused."""

    parts: DataFrame
    journal: DataFrame
    ledger: DataFrame
    snapshots: DataFrame
    refused: DataFrame


LEDGER = "doc_id long, issue_key string, action string, result_sha string"


def apply(parts: DataFrame, items: DataFrame, headers: DataFrame, stamp: str, ledger: DataFrame | None = None, snapshots: DataFrame | None = None, dry_run: bool = False, strict: bool = True, keep: int = KEEP, settle=durable, edit=edited) -> Applied:
    """Guarded edits: the one way by which documents change.

    parts: PARTS; items: a plan's, with params; headers(doc_id, sha256): the documents that the plan was made for. A plan that
    the guard refuses changes nothing, nor does an item that the ledger has for the document as it is. Documents that change
    are kept as they were among the snapshots, under `stamp`. A dry run returns the journal and changes nothing. `settle`
    makes intermediate results durable; they are used more than once. `edit` makes PARTS with the journal of parts and items:
    the fold, or what edits files and parses them.
    """
    spark = parts.sparkSession
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    snapshots = snapshots if snapshots is not None else parts.limit(0).withColumn("stamp", F.lit("")).withColumn("dup_no", F.lit(0))
    before = settle(state_hash(parts))
    checks = settle(guard(items, headers, before, strict))
    refused = checks.filter(~F.col("reason").startswith("warn")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    on = items.filter("enabled").join(before, "doc_id", "left")
    stopped = on.join(refused, "doc_id").select("doc_id", F.lit(0).alias("step"), "issue_key", "action", F.concat(F.lit("failed: "), "reason").alias("status"))
    free = on.join(refused, "doc_id", "left_anti")
    todo = settle(pending(free, ledger).drop("sha256"))
    noted = free.join(todo.select("doc_id", "issue_key"), ["doc_id", "issue_key"], "left_anti").select("doc_id", F.lit(0).alias("step"), "issue_key", "action", F.lit("skipped: in ledger").alias("status"))
    touched = todo.select("doc_id").distinct()
    out = settle(edit(parts.join(touched, "doc_id", "left_semi"), todo))
    journal = of_kind(out, "journal").unionByName(stopped).unionByName(noted)
    if dry_run:
        return Applied(parts, journal, ledger, snapshots, checks)
    changed = settle(out.filter("status = 'applied'").select("doc_id").distinct())
    now = parts.join(changed, "doc_id", "left_anti").unionByName(out.filter("kind <> 'journal'").join(changed, "doc_id", "left_semi"))
    again = snapshots.filter(F.col("stamp") == stamp).groupBy("doc_id").agg((F.max("dup_no") + 1).alias("next"))
    old = parts.join(changed, "doc_id", "left_semi").join(again, "doc_id", "left").withColumn("stamp", F.lit(stamp)).withColumn("dup_no", F.coalesce("next", F.lit(0))).drop("next")
    marks = of_kind(out, "journal").filter(~F.col("status").startswith("failed")).join(state_hash(now), "doc_id").select("doc_id", "issue_key", "action", F.col("sha256").alias("result_sha"))
    # what was done before still holds for the document as it is now
    carried = ledger.join(changed, "doc_id").join(state_hash(now), "doc_id").select("doc_id", "issue_key", "action", F.col("sha256").alias("result_sha"))
    return Applied(now, journal, ledger.unionByName(marks).unionByName(carried).distinct(), kept_snapshots(snapshots.unionByName(old), keep), checks)
