"""An append-only evidence log with a hash chain, and a store of promoted entries."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.state import append_line, file_lock, write_json

GENESIS = "0" * 64
#: Events of one block of a log table: a block is chained in one task.
BLOCK = 4096
#: Blocks whose digests meet in one task.
FAN = 4096
EVENT_TYPES = ("PROPOSED", "SCREENED", "FROZEN", "CONFIRMED", "REJECTED", "RETRACTED", "REPLICATED", "NOTE")
EVENT = "event_id string, hypothesis_id string, event_type string, timestamp_utc string, payload string, previous_hash string, event_hash string"


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_loads(text: str):
    """JSON without repeated keys or non-finite numbers."""

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                raise ValueError(f"repeated key {k}")
            out[k] = v
        return out

    def bad(name):
        raise ValueError(f"{name} isn't a number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=bad)


def content_hash(seq, payload, previous):
    """Digest of an event: its place, its payload and its predecessor's digest (Columns)."""
    return F.sha2(F.concat_ws("|", seq.cast("string"), payload, previous), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def anchors(log: DataFrame) -> DataFrame:
    """(block, anchor): what the first event of each block follows, a digest of all blocks before it; GENESIS for the first.

    Blocks are digested side by side, then runs of FAN blocks; what meets in one task is one digest a run,
    and one digest a block of one run.  The first run follows GENESIS, a later one the digests of all runs before it.
    """
    block = F.floor(F.col("seq") / BLOCK).alias("block")
    each = log.groupBy(block).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: F.concat_ws("|", x["seq"].cast("string"), x["payload"])), "\n"), 256).alias("digest"))

    def link(part: pd.DataFrame, now: str) -> pd.DataFrame:
        part, out = part.sort_values("block"), []
        for d in part["digest"]:
            out.append(now)
            now = _sha(f"{now}|{d}")
        return pd.DataFrame({"block": part["block"], "anchor": out})

    each = each.withColumn("run", F.floor(F.col("block") / FAN))
    run_digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), "|"), 256)
    runs = each.groupBy("run").agg(run_digest.alias("digest")).select(F.col("run").alias("block"), "digest")
    starts = runs.groupBy(F.lit(0).alias("all")).applyInPandas(lambda part: link(part, GENESIS), "block long, anchor string").select(F.col("block").alias("run"), F.col("anchor").alias("start"))
    return each.join(starts, "run").groupBy("run").applyInPandas(lambda part: link(part, part["start"].iloc[0]), "block long, anchor string")


def chained(events: DataFrame) -> DataFrame:
    """An event table as a log: each event's digest covers its predecessor's, and so all events before it."""
    d = events.select(F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.col("user_id").cast("string"), "props").alias("payload"))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "payload"])
        now, before, own = part["anchor"].iloc[0], [], []
        for seq, payload in zip(part["seq"], part["payload"], strict=True):
            before.append(now)
            now = _sha(f"{seq}|{payload}|{now}")
            own.append(now)
        return pd.DataFrame({"seq": part["seq"], "payload": part["payload"], "event_hash": own, "previous_hash": before})

    placed = d.withColumn("block", F.floor(F.col("seq") / BLOCK)).join(anchors(d), "block")
    return placed.groupBy("block").applyInPandas(chain, "seq long, payload string, event_hash string, previous_hash string")


def verify(log: DataFrame) -> DataFrame:
    """One row: events, links that don't match the event before, wrong digests, repeated ids, and whether all holds.

    Neighbours meet by an equi-join on their place, not in a window over the log; the first event
    of a block is held against the digest of all blocks before it.  A gap breaks the link after it.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_before"))
    starts = log.groupBy(F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.min("seq").alias("seq")).join(anchors(log), "block").select("seq", "anchor")
    d = log.join(before, "seq", "left").join(starts, "seq", "left")
    link = F.coalesce(F.col("previous_hash") == F.coalesce("anchor", "_before"), F.lit(False))
    good = F.col("event_hash") == content_hash(F.col("seq"), F.col("payload"), F.col("previous_hash"))
    twice = log.groupBy("seq").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_ids"))
    s = d.agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum((~link).cast("long")), F.lit(0)).alias("broken_links"), F.coalesce(F.sum((~good).cast("long")), F.lit(0)).alias("wrong_hashes"))
    return s.crossJoin(twice).withColumn("valid", (F.col("broken_links") == 0) & (F.col("wrong_hashes") == 0) & (F.col("duplicate_ids") == 0))


class Log:
    """One JSON line an event, appended under a lock and only after the whole chain is verified."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def events(self, hypothesis_id: str | None = None) -> list[dict]:
        out = []
        if self.path.exists():
            for n, line in enumerate(self.path.read_text("utf-8").splitlines(), 1):
                if not line.strip():
                    raise ValueError(f"line {n} is blank")
                e = strict_loads(line)
                if not isinstance(e, dict):
                    raise ValueError(f"line {n} isn't an object")
                out.append(e)
        if errors := self._errors(out):
            raise ValueError("; ".join(errors))
        return [e for e in out if hypothesis_id in (None, e["hypothesis_id"])]

    @staticmethod
    def _hash(e: dict) -> str:
        return hashlib.sha256(canonical_json({k: v for k, v in e.items() if k != "event_hash"}).encode()).hexdigest()

    def _errors(self, events: list[dict]) -> list[str]:
        out, before, seen = [], GENESIS, set()
        for k, e in enumerate(events):
            if e.get("previous_hash") != before:
                out.append(f"event {k}: broken link")
            if e.get("event_hash") != self._hash(e):
                out.append(f"event {k}: wrong digest")
            if e.get("event_id") in seen:
                out.append(f"event {k}: repeated id")
            seen.add(e.get("event_id"))
            before = e.get("event_hash")
        return out

    def verify(self) -> dict:
        try:
            n = len(self.events())
        except ValueError as error:
            return {"valid": False, "errors": str(error)}
        return {"valid": True, "events": n}

    def append(self, hypothesis_id: str, event_type: str, payload: dict) -> dict:
        if event_type not in EVENT_TYPES:
            raise ValueError(f"unknown event type {event_type}")
        with file_lock(self.path):
            return self._append(hypothesis_id, event_type, payload)

    def _append(self, hypothesis_id: str, event_type: str, payload: dict) -> dict:
        held = self.events()
        e = {"event_id": f"{len(held):08d}", "hypothesis_id": hypothesis_id, "event_type": event_type, "timestamp_utc": datetime.now(UTC).isoformat(), "payload": strict_loads(canonical_json(payload)), "previous_hash": held[-1]["event_hash"] if held else GENESIS}
        e["event_hash"] = self._hash(e)
        append_line(self.path, canonical_json(e))
        return e


def promote(store: DataFrame, staged: DataFrame, confirmed: DataFrame, most: int) -> DataFrame:
    """(entry_id, successes, gain): staged entries of confirmed hypotheses are merged in, counts add up, the best `most` stay."""
    new = staged.join(confirmed.select("hypothesis_id").distinct(), "hypothesis_id", "left_semi").select("entry_id", F.lit(1).alias("successes"), "gain")
    both = store.select("entry_id", "successes", "gain").unionByName(new)
    return both.groupBy("entry_id").agg(F.sum("successes").alias("successes"), F.max("gain").alias("gain")).orderBy(F.desc("successes"), F.desc("gain"), "entry_id").limit(most)


def stage(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert what isn't there yet."""
    return store.unionByName(new.join(store.select(key), key, "left_anti").dropDuplicates([key]))


def confirm(df: DataFrame, expression, target: str, maximum_nmse: float, log: Log, hypothesis_id: str) -> dict:
    """One look at the held-out rows: errors, a verdict, and two events; a second look raises."""
    from quillon.operators import metrics

    if any(e["event_type"] in ("CONFIRMED", "REJECTED") for e in log.events(hypothesis_id)):
        raise ValueError("this hypothesis was confirmed or rejected before")
    y = F.col(target)
    r = df.agg(metrics.mse(y, expression).alias("mse"), metrics.nmse(y, expression).alias("nmse"), F.avg(F.abs(y - expression)).alias("mae"), metrics.r2(y, expression).alias("r2")).first().asDict()
    log.append(hypothesis_id, "FROZEN", {"maximum_nmse": maximum_nmse})
    passed = r["nmse"] is not None and r["nmse"] <= maximum_nmse
    log.append(hypothesis_id, "CONFIRMED" if passed else "REJECTED", r)
    return r | {"passed": passed}


def validate_entry(row: dict, n_features: int = 1, points: int = 19) -> dict:
    """A store entry with its canonical form, after checks: id, finite gain, and a replay on a grid that must be finite where it is defined."""
    from quillon.functions import expressions as ex

    if not str(row.get("entry_id", "")).strip():
        raise ValueError("an entry needs an id")
    gain = row.get("gain")
    if isinstance(gain, bool) or not isinstance(gain, int | float) or gain != gain or abs(gain) == float("inf"):
        raise ValueError("the gain must be a finite number")
    text = ex.canonical(str(row["expression"]), n_features)
    values = ex.probe(text, [[-1.5 + 3 * k / (points - 1)] * n_features for k in range(points)])
    if not any(v is not None for v in values) or any(v is not None and not abs(v) < float("inf") for v in values):
        raise ValueError("the expression has no finite value on the grid")
    return {**row, "canonical": text, "probe": [None if v is None else round(v, 12) for v in values]}


def confirmations(log: Log) -> set[str]:
    """Hypotheses whose last verdict in a log is a confirmation that passed its own bound; a log whose chain doesn't hold raises."""
    check = log.verify()
    if not check["valid"]:
        raise ValueError(f"the log doesn't hold: {check['errors']}")
    frozen, out = {}, set()
    for e in log.events():
        h, payload = e["hypothesis_id"], e["payload"]
        if e["event_type"] == "FROZEN":
            frozen[h] = payload.get("maximum_nmse")
        elif e["event_type"] == "CONFIRMED" and frozen.get(h) is not None and payload.get("nmse") is not None and payload["nmse"] <= frozen[h]:
            out.add(h)
        elif e["event_type"] in ("REJECTED", "RETRACTED"):
            out.discard(h)
    return out


def promote_confirmed(store: DataFrame, staged: DataFrame, log: Log, hypothesis_id: str, most: int) -> DataFrame:
    """promote() for the staged entries of one hypothesis, and only after its confirmation is found in a log that holds; else raises."""
    if hypothesis_id not in confirmations(log):
        raise ValueError(f"{hypothesis_id} has no confirmation that passed")
    mine = staged.where(F.col("hypothesis_id") == hypothesis_id)
    if mine.isEmpty():
        raise ValueError(f"nothing is staged for {hypothesis_id}")
    return promote(store, staged, mine.select("hypothesis_id"), most)


def persist_hypothesis(folder: str | Path, spec: dict, log: Log, validation: dict | None = None) -> Path:
    """A hypothesis as a JSON file of its own, PROPOSED in the log once; the same id with another expression raises.

    validation: metrics and the fingerprint of the rows they are of, logged once for each fingerprint.  Calling again changes nothing.
    """
    ident, text = str(spec.get("hypothesis_id", "")).strip(), str(spec.get("expression", "")).strip()
    if not ident or not text or Path(ident).name != ident:
        raise ValueError("a hypothesis needs an id that can name a file, and an expression")
    path = Path(folder) / f"{ident}.json"
    with file_lock(path.with_name(f".{ident}")):
        if path.exists():
            spec = strict_loads(path.read_text("utf-8"))
            if spec.get("expression") != text:
                raise ValueError(f"{ident} is there with another expression")
        else:
            write_json(path, spec)
    held = log.events(ident)
    if not any(e["event_type"] == "PROPOSED" for e in held):
        log.append(ident, "PROPOSED", {"expression": spec["expression"], "spec_sha256": _sha(canonical_json(spec))})
    if validation is not None and not any(e["event_type"] == "SCREENED" and e["payload"].get("fingerprint") == validation.get("fingerprint") for e in held):
        log.append(ident, "SCREENED", validation)
    return path


def payload_table(events: DataFrame, event_type: str, most: int = 512) -> DataFrame:
    """The events of a type as a table: place, hypothesis and one text column for each field of any payload, by name.

    events: seq, hypothesis_id, event_type, payload (JSON).  Values that aren't text are JSON; a field that a payload hasn't is null.
    """
    d = events.where(F.col("event_type") == event_type).select("seq", "hypothesis_id", F.from_json("payload", "map<string,string>").alias("_p"))
    fields = [r.k for r in d.select(F.explode(F.map_keys("_p")).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(fields) > most:
        raise ValueError("more fields than a table takes")
    return d.select("seq", "hypothesis_id", *[F.col("_p")[f].alias(f) for f in fields])


def export(events: DataFrame, folder: str, types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Every type of event that there is as a CSV folder, rebuilt from the log alone, and a manifest (path, sha256) of the files, which is written beside them as JSON."""
    spark = events.sparkSession
    there = {r.event_type for r in events.select("event_type").distinct().collect()}
    if unknown := there - set(types):
        raise ValueError(f"unknown event types {sorted(unknown)}")
    for t in [t for t in types if t in there]:
        payload_table(events, t).write.mode("overwrite").csv(f"{folder}/{t.lower()}", header=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
    manifest = files.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")
