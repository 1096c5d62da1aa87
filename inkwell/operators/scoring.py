"""Hooks for models: scorers, chat back ends, extractors and encoders run over Arrow batches, each loaded once in a task.

Distinct inputs are scored once: they are deduplicated by content hash before the model and joined back after it.  A call
that fails gives null and a status, never a made-up score.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import grounding as G
from ..functions import text as T
from ..sources import files
from .batches import ROWS, parts

#: Name to a factory; a factory's product takes a list of (premise, claim) and returns a list of (entailment, contradiction).
SCORERS: dict[str, Callable[[], Callable]] = {}


def scorer(name: str):
    def put(factory):
        SCORERS[name] = factory
        return factory

    return put


@scorer("overlap")
def overlap_scorer():
    """Deterministic and without a model: the share of the claim's words that the premise has."""
    import re

    word = re.compile("[a-zà-ÿ]+")

    def score(pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        out = []
        for premise, claim in pairs:
            have, want = set(word.findall(premise.lower())), set(word.findall(claim.lower()))
            out.append((len(have & want) / len(want) if want else 0.0, 0.0))
        return out

    return score


def fresh_scores(once: DataFrame, name: str, batch: int = 32, keep: str | None = None) -> DataFrame:
    """(premise, claim, entail, contradict, error) of each row, or (``keep``, entail, contradict, error); every row goes through the model."""
    if name not in SCORERS:
        raise ValueError(f"no scorer {name!r}; there are {sorted(SCORERS)}")
    factory, own = SCORERS[name], [keep] if keep else ["premise", "claim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in (x for whole in batches for x in parts(whole, max(batch, ROWS))):
            xs, out = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), []
            for k in range(0, len(xs), batch):
                try:
                    out += [(e, c, None) for e, c in model([(p or "", q or "") for p, q in xs[k : k + batch]])]
                except Exception as e:  # noqa: BLE001  a model's failure is a result
                    out += [(None, None, repr(e)[:200])] * len(xs[k : k + batch])
            e, c, err = zip(*out, strict=True) if out else ((), (), ())
            mine = [b.column(2)] if keep else [b.column(0), b.column(1)]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(e, pa.float64()), pa.array(c, pa.float64()), pa.array(err, pa.string())], [*own, "entail", "contradict", "error"])

    schema = ", ".join(f"{x} string" for x in own) + ", entail double, contradict double, error string"
    return once.select("premise", "claim", *([keep] if keep else [])).mapInArrow(run, schema)


def scored_pairs(pairs: DataFrame, name: str = "overlap", batch: int = 32) -> DataFrame:
    """Adds entail, contradict and error to rows (premise, claim, ...)."""
    return pairs.join(fresh_scores(pairs.select("premise", "claim").distinct(), name, batch), ["premise", "claim"], "left")


def entailment_faithfulness(df: DataFrame, key: list[str], text: str, premises: str, subject: str | None, words: str, years: str, name: str = "overlap", veto: bool = False, cache=None) -> DataFrame:
    """key, F, unsupported, status: each claim against each premise of its own row; claims without their hedges are scored.

    With a ``cache.ScoreCache`` only pairs that it doesn't know are scored, when this is called, and kept for later runs; the rows' claims are
    split once and written.
    Claims and premises are exploded within a row only, and reduced to a claim's maximum before anything else.
    """
    held = df.select(*key, T.split_claims(F.col(text), F.col(subject) if subject else None).alias("claims"), F.col(premises).alias("premises"), F.col(words).alias("words"), F.col(years).alias("years"))
    if cache:  # read by several jobs
        at = files.folder(df.sparkSession, "claims")
        held.write.parquet(at)
        held = df.sparkSession.read.schema(held.schema).parquet(at)
    each = held.select(*key, "words", "years", "premises", F.posexplode("claims").alias("c", "claim"))
    pairs = each.select(*key, "c", T.strip_hedges(F.col("claim")).alias("claim"), F.explode("premises").alias("premise"))
    scored = cache.scores(pairs) if cache else scored_pairs(pairs, name)
    top = scored.groupBy(*key, "c").agg(F.max("entail").alias("entail"), F.max("contradict").alias("contradict"))
    tagged = each.join(top, [*key, "c"]).withColumn("tag", G.claim_tag(F.coalesce("entail", F.lit(0.0)), F.coalesce("contradict", F.lit(0.0)), G.invented_specific(F.col("claim"), F.col("words"), F.col("years")), veto))
    counts = tagged.groupBy(*key).agg(F.count_if(F.col("tag") == "supported").alias("ok"), F.count_if(F.col("tag").isin("contradicted", "invented")).alias("bad"))
    out = held.join(counts, key, "left").withColumn("v", G.verdict(F.size("claims"), F.size("premises"), F.coalesce("ok", F.lit(0)), F.coalesce("bad", F.lit(0))))
    return out.select(*key, "v.F", "v.unsupported", "v.status")


class Pace:
    """At most ``rate`` starts a second among the threads of a task, evenly spaced; any number where the rate is None."""

    def __init__(self, rate: float | None) -> None:
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(at - now)


def _within(deadline: float | None, ask: Callable[[str], str], prompt: str) -> str:
    """The answer, or TimeoutError; a call past its deadline is left to end by itself, in a thread that holds nothing up."""
    if deadline is None:
        return ask(prompt)
    got: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got.put((ask(prompt), None))
        except Exception as e:  # noqa: BLE001
            got.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        answer, error = got.get(timeout=deadline)
    except queue.Empty:
        raise TimeoutError(f"no answer within {deadline} s") from None
    if error:
        raise error
    return answer


def chat_column(
    df: DataFrame, prompt: str, out: str, call: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 2.0, pause: float = 0.0, at_once: int = 1, per_second: float | None = None, tasks: int = 8, deadline: float | None = None
) -> DataFrame:
    """Adds ``out`` and ``<out>_status``: the answer of a chat model to each distinct prompt, tried up to ``tries`` times.

    A task has up to ``at_once`` calls open (more than one asks for a model that threads may share).  ``per_second`` bounds the calls
    that all tasks start: the prompts are dealt out over ``tasks`` tasks, each of which paces its own share, so fewer running tasks
    are slower and never faster (a task that Spark repeats after a loss repeats its calls).  A failed or empty answer is
    tried again after ``wait``, twice ``wait`` and so on; a call without an answer within ``deadline`` seconds has failed.
    """

    def answered(ask: Callable[[str], str], pace: Pace, p: str) -> tuple[str | None, str]:
        answer, state = None, "failed"
        for k in range(tries):
            pace.wait()
            try:
                answer, state = _within(deadline, ask, p), "ok"
            except Exception as e:  # noqa: BLE001
                answer, state = None, f"failed: {e!r}"[:200]
            if answer:
                break
            time.sleep(wait * 2**k if k < tries - 1 else 0)
        time.sleep(pause)
        return answer, "empty" if state == "ok" and not answer else state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, pace = call(), Pace(per_second / tasks if per_second else None)
        with ThreadPoolExecutor(at_once) as pool:
            for b in (x for whole in batches for x in parts(whole)):
                got = list(pool.map(lambda p: answered(ask, pace, p), b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([s for _, s in got], pa.string())], [prompt, out, f"{out}_status"])

    once = df.select(prompt).distinct()
    once = (once.repartition(tasks) if per_second else once).mapInArrow(run, f"`{prompt}` string, `{out}` string, `{out}_status` string")
    return df.join(once, prompt, "left")


def observed(scored: DataFrame, status: str = "status", name: str = "scores") -> tuple[DataFrame, Observation]:
    """The same rows, and counters that fill in the pass that computes them: rows, scored, vacuous, fallback and failed.

    ``get`` of the second has them once an action over the first has ended; no further job runs.
    """
    seen, s = Observation(name), F.coalesce(F.col(status), F.lit(""))
    kinds = {"scored": s == G.SCORED, "vacuous": s.startswith("unscoreable:"), "fallback": s.startswith("fallback"), "failed": s.startswith("failed")}
    return scored.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in kinds.items())), seen


def deduplicated(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each content hash of the key columns, the one with the smallest values of all columns."""
    rest = [c for c in df.columns]
    return df.groupBy(F.sha1(F.concat_ws("\0", *key)).alias("content_hash")).agg(F.min(F.struct(*rest)).alias("r")).select("content_hash", "r.*")
