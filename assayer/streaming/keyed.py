"""Keyed-state streams: repeated failures, alert cooldowns, incidents, crawl targets.

Each has a batch twin (with_recent_failures, alert_cooldown, incidents, frontier_states). A key's rows are taken in the
order of (at, seq) within a micro-batch, at once, since an alert does not wait; so a stream gives its twin's rows where no
micro-batch holds rows older than those of an earlier one. `late` is the watermark: rows older than the latest time less
`late` are left out, and a key's state ends when the watermark passes the time after which it can tell nothing.

A call of Python costs more than thousands of rows do, so keys are dealt by hash to `buckets`, and a call takes all rows of a
bucket in a micro-batch. State is a row per bucket with the values of its keys: a micro-batch rewrites the buckets that it
touches, and streams of very many keys want more buckets. The number stays for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.alerts import SEVERITIES, fires
from assayer.operators.crawl import TERMINAL


BUCKETS = 1024

#: What is known of a key: the microseconds until which it is kept (None: for good) and its value.
Kept = tuple[int | None, tuple]


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "seq"])


def _micros(rows: pd.DataFrame) -> np.ndarray:
    return rows["at"].to_numpy("datetime64[us]").astype(np.int64)


def _numbered(rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Each row's number of its key, and the keys by number; a null is a key like others."""
    codes = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    firsts = rows[keys].iloc[np.unique(codes, return_index=True)[1]]
    return codes, [tuple(v if isinstance(v, str) else None for v in key) for key in firsts.itertuples(index=False, name=None)]


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)


def _one_by_one(step: Callable[[tuple, pd.DataFrame, tuple | None], tuple], join: Callable[[list], pd.DataFrame] = _joined) -> Callable:
    """A step over the rows of one key and its value (None: a new one), for _keyed; join: what the keys of a bucket give -> rows out."""

    def run(rows: pd.DataFrame, codes: np.ndarray, keys: list[tuple], known: dict[tuple, Kept]) -> tuple[pd.DataFrame, dict[tuple, Kept]]:
        order = np.argsort(codes, kind="stable")
        rows, edges = rows.iloc[order], np.searchsorted(codes[order], np.arange(len(keys) + 1))
        found, told = [], {}
        for key, a, b in zip(keys, edges, edges[1:], strict=False):
            out, told[key] = step(key, rows.iloc[a:b], known[key][1] if key in known else None)
            found.append(out)
        return join(found), told

    return run


def _keyed(rows: DataFrame, keys: list[str], step: Callable, schema: str, state: str, mode: str, late: str, buckets: int, end: Callable[[tuple], tuple | None] = lambda value: None) -> DataFrame:
    """step: rows of a bucket in order, their keys' numbers, the keys and what is known -> rows out, what is known of these keys now.

    end: what remains of a value whose time is over (None: nothing). Keys are strings.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        watermark = kept.getCurrentWatermarkMs()
        known = {tuple(e.key): (e.until, tuple(e.value)) for e in kept.get[0]} if kept.exists else {}
        over = {k: end(value) for k, (until, value) in known.items() if until is not None and until // 1000 < watermark}
        known = {k: (None, over[k]) if k in over else v for k, v in known.items() if over.get(k, v) is not None}
        if not kept.hasTimedOut:
            given = _ordered(frames)
            on_time = given[_micros(given) >= watermark * 1000]  # Spark itself lets rows pass for one more micro-batch
            if len(on_time):
                found, told = step(on_time, *_numbered(on_time, keys), known)
                known |= {k: (None if until is None else max(until, (watermark + 1) * 1000), value) for k, (until, value) in told.items()}
                yield found
        entries = [(list(k), until, value) for k, (until, value) in known.items()]
        if entries:
            kept.update((entries,))
            ends = [until for _, until, _ in entries if until is not None]
            if ends:
                kept.setTimeoutTimestamp(max(min(ends) // 1000, watermark + 1))
        elif kept.exists:
            kept.remove()

    dealt = rows.withWatermark("at", late).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    entry = f"entries array<struct<key: array<string>, until: bigint, value: struct<{', '.join(': '.join(c.split()) for c in state.split(', '))}>>>"
    return dealt.groupBy("_bucket").applyInPandasWithState(run, schema, entry, mode, GroupStateTimeout.EventTimeTimeout)


def repeated_failures_stream(events: DataFrame, seconds: int = 600, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(task_id, seq, recent_failures) for each job_failed event of (task_id, seq, at, kind).

    State: the times of a task's failures of the last `seconds`, and how many fell on each; it ends `seconds` after the last.
    """

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[pd.DataFrame, Kept]:
        times, counts = value or ([], [])
        at = _micros(rows)
        new, n = np.unique(at, return_counts=True)
        all_at = np.concatenate([np.array(times, np.int64), new])
        all_n = np.concatenate([np.array(counts, np.int64), n])
        order = np.argsort(all_at, kind="stable")
        all_at, total = all_at[order], np.concatenate([[0], np.cumsum(all_n[order])])
        window = seconds * 1_000_000
        found = total[np.searchsorted(all_at, at, "right")] - total[np.searchsorted(all_at, at - window, "left")]
        keep = all_at >= all_at[-1] - window
        now = int(all_at[-1]) + window, (all_at[keep].tolist(), all_n[order][keep].tolist())
        return pd.DataFrame({"task_id": pd.Series([key[0]] * len(rows), dtype=object), "seq": rows["seq"].to_numpy(), "recent_failures": found}), now

    failed = events.where("kind = 'job_failed' and task_id <> ''")
    return _keyed(failed, ["task_id"], _one_by_one(step), "task_id string, seq long, recent_failures long", "times array<long>, counts array<long>", "append", late, buckets)


def alert_cooldown_stream(matches: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(rule_id, scope_key, seq, at) of the matches that fire. State: the last firing; it ends with the cooldown."""

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[pd.DataFrame, Kept]:
        gap = rows["cooldown_seconds"].to_numpy(np.int64) * 1_000_000
        kept, last = fires(_micros(rows), gap, value[0] if value else None)
        names = {n: pd.Series([v] * int(kept.sum()), dtype=object) for n, v in zip(("rule_id", "scope_key"), key, strict=True)}
        return pd.DataFrame(names | {"seq": rows["seq"].to_numpy()[kept], "at": rows["at"].to_numpy()[kept]}), (last + int(gap.max()), (last,))

    return _keyed(matches, ["rule_id", "scope_key"], _one_by_one(step), "rule_id string, scope_key string, seq long, at timestamp", "last long", "append", late, buckets)


def incident_stream(alerts: DataFrame, forget: int = 30 * 86400, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The columns of alerts.incidents, and status: each incident as it stands after a micro-batch.

    alerts (client_id, dedup_key, at, seq, severity, job_id, domain, ends): a row with ends = 1 closes the open incident; at one
    time alerts come before endings. State: the last incident with the names of its jobs and domains. An incident that stays
    open keeps its state; of one that ended, nothing but its number is left `forget` seconds after the key's last row, so
    numbers go on however long a key was silent.
    """
    levels = {s: k for k, s in enumerate(SEVERITIES)}
    moment = lambda micros: pd.Timestamp(micros, unit="us") if micros is not None else pd.NaT

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[list[tuple], Kept]:
        rows = rows.iloc[np.lexsort((rows["ends"], _micros(rows)))]  # of one time and kind, the order of seq stays
        number, count, rank, open_, started, jobs, domains = value or (0, 0, 0, False, None, [], [])
        at, ends = _micros(rows), rows["ends"].to_numpy(bool)
        ranks = np.array([levels.get(s, 0) for s in rows["severity"]])
        named = {c: rows[c].tolist() for c in ("job_id", "domain")}
        out: dict[int, tuple] = {}
        closed = np.flatnonzero(ends)
        for a, b in zip([0, *(closed + 1)], [*closed, len(rows)], strict=True):  # stretches between endings, not rows
            if b > a:
                if not open_:
                    number, count, rank, started, jobs, domains = number + 1, 0, 0, int(at[a]), [], []
                names = lambda c: {x for x in named[c][a:b] if isinstance(x, str) and x}  # noqa: B023, E731
                count, rank = count + b - a, max(rank, int(ranks[a:b].max()))
                jobs, domains, open_ = sorted({*jobs, *names("job_id")}), sorted({*domains, *names("domain")}), True
            if open_:
                open_ = b == len(rows)
                out[number] = (*key, number, int(count), SEVERITIES[rank], jobs, domains, moment(started), moment(None if open_ else int(at[b])), "open" if open_ else "resolved")
        values = (int(number), int(count), int(rank), bool(open_), started, jobs, domains)
        until = None if open_ else int(at[-1]) + forget * 1_000_000
        return list(out.values()), (until, values)

    schema = "client_id string, dedup_key string, number long, occurrences long, severity string, jobs array<string>, domains array<string>, started_at timestamp, ended_at timestamp, status string"
    kept = "number long, count long, rank long, open boolean, started long, jobs array<string>, domains array<string>"
    kinds = {c.split()[0]: "datetime64[ns]" if c.endswith("timestamp") else np.int64 if c.endswith("long") else object for c in schema.split(", ")}
    join = lambda found: pd.DataFrame([r for rows in found for r in rows], columns=list(kinds)).astype(kinds)
    shrink = lambda value: (value[0], 0, 0, False, None, [], [])
    return _keyed(alerts, ["client_id", "dedup_key"], _one_by_one(step, join), schema, kept, "update", late, buckets, shrink)


def frontier_stream(outcomes: DataFrame, max_attempts: int = 3, forget: int = 30 * 86400, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(url, state, attempts, delay_seconds): each crawl target as it stands after a micro-batch of fetch outcomes (url, at, seq, ok, blocked).

    Outcomes of a target that has ended change nothing. State: its name and attempts; it ends `forget` seconds after a
    target's last outcome, and the target may be tried anew. All targets of a bucket take their step at once, in arrays.
    """

    def step(rows: pd.DataFrame, codes: np.ndarray, keys: list[tuple], known: dict[tuple, Kept]) -> tuple[pd.DataFrame, dict[tuple, Kept]]:
        before = [known[k][1] if k in known else ("QUEUED", 0) for k in keys]
        names, tried = np.array([b[0] for b in before], object), np.array([b[1] for b in before], np.int64)
        attempt = tried[codes] + pd.Series(codes).groupby(codes).cumcount().to_numpy() + 1
        going = ~np.isin(names, TERMINAL)
        counts = going[codes] & (attempt <= max_attempts)
        blocked, ok = (rows[c].eq(True).to_numpy(bool) for c in ("blocked", "ok"))  # null: no
        np.maximum.at(tried, codes[counts], attempt[counts])
        names[going] = np.where(tried[going] >= max_attempts, "FAILED", "RETRY_WAIT")
        ends = np.flatnonzero(counts & (ok | blocked))
        ended, first = np.unique(codes[ends], return_index=True)
        first = ends[first]
        names[ended], tried[ended] = np.where(blocked[first], "POLICY_REFUSED", "PROCESSED"), attempt[first]
        last = np.zeros(len(keys), np.int64)
        last[codes] = _micros(rows)  # rows are in the order of time, so a key's last one stays
        wait = np.where(names == "RETRY_WAIT", np.minimum(2.0 ** (tried - 1), 30.0), np.nan)
        found = pd.DataFrame({"url": pd.Series([k[0] for k in keys], dtype=object), "state": names, "attempts": tried, "delay_seconds": wait})
        return found, {k: (until, (name, n)) for k, until, name, n in zip(keys, (last + forget * 1_000_000).tolist(), names.tolist(), tried.tolist(), strict=True)}

    return _keyed(outcomes, ["url"], step, "url string, state string, attempts long, delay_seconds double", "name string, attempts long", "update", late, buckets)
