"""Best of N while candidates keep arriving: the batch rules of ``selection.pick``, kept up to date batch by batch.

Each batch is reduced to its best candidates by record and rule, and written below ``data``; then a marker of the batch's name
in ``commits`` names that folder.  Only marked batches count, a batch marked already is passed over, and the best of bests is
the best, so any split of the candidates, repeated batches and restarts in the middle give the result of one batch.
A batch costs what it holds, not what has been seen; ``compact`` folds the folders into one, whose marker in ``bases`` names the
batches and folders that it replaces.

Candidates are only added: one that comes again with other scores counts with the best of them, and one that is taken back stays.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import selection
from ..sources import files


class BestOfN:
    """Picks below ``where`` for the rewards and gate of ``selection.pick``; one writer at a time."""

    def __init__(self, spark: SparkSession, where: str, rewards: list[str], gate_unsup: int = 1, eligible: Column | None = None) -> None:
        self.spark, self.where, self.gate_unsup, self.eligible = spark, where, gate_unsup, eligible
        self.rewards = list(rewards)
        self.picks_made = [*(f"pick_{r}" for r in rewards), "pick_gated"]

    def _markers(self) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
        """Folder by committed batch, and for each base what it replaces (folder by batch; its own name for an older base)."""
        commits = {b: files.get(self.spark, f"{self.where}/commits/{b}") for b in files.names(self.spark, f"{self.where}/commits")}
        bases = {b: dict(line.split("\t") for line in files.get(self.spark, f"{self.where}/bases/{b}").splitlines()) for b in files.names(self.spark, f"{self.where}/bases")}
        return commits, bases

    def batches(self) -> set[str]:
        """Names of all batches that count."""
        commits, bases = self._markers()
        return set(commits) | {b for held in bases.values() for b, folder in held.items() if b != folder}

    def add(self, candidates: DataFrame, batch: str) -> bool:
        """Adds candidates (record_id, i, ..); false where a batch of this name is there already."""
        if not batch or set(batch) & set("/\t\n"):
            raise ValueError(f"no name for a batch: {batch!r}")
        if batch in self.batches():
            return False
        rules = selection.rules(candidates, self.rewards, self.gate_unsup, self.eligible)
        best = [F.max(F.when(where & score.isNotNull(), F.struct(score.alias("s"), (-F.col("i")).alias("t")))).alias(name) for name, (score, where) in rules.items()]
        folder = uuid.uuid4().hex
        candidates.groupBy("record_id").agg(*best).write.parquet(f"{self.where}/data/{folder}")
        files.commit(self.spark, f"{self.where}/commits/{batch}", folder)
        return True

    def state(self) -> DataFrame | None:
        """record_id and the best (score, minus index) of each rule over all batches; None where nothing was added."""
        commits, bases = self._markers()
        gone = {folder for held in bases.values() for folder in held.values()}
        folders = sorted((set(commits.values()) | set(bases)) - gone)
        if not folders:
            return None
        read = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.where}/data/{f}") for f in folders])
        return read.groupBy("record_id").agg(*(F.max(p).alias(p) for p in self.picks_made))

    def picks(self) -> DataFrame | None:
        """record_id and each pick, as ``selection.pick`` returns them."""
        held = self.state()
        return None if held is None else held.select("record_id", *((-F.col(p)["t"]).alias(p) for p in self.picks_made))

    def compact(self) -> None:
        """One folder in place of those there are."""
        commits, bases = self._markers()
        held = self.state()
        if held is None:
            return
        folder = uuid.uuid4().hex
        held.write.parquet(f"{self.where}/data/{folder}")
        replaced = {k: v for base in bases.values() for k, v in base.items()} | commits | {b: b for b in bases}
        files.commit(self.spark, f"{self.where}/bases/{folder}", "\n".join(f"{k}\t{v}" for k, v in sorted(replaced.items())))

    def drop_replaced(self) -> None:
        """Deletes what the newest base covers, for a time when no one else reads or writes."""
        commits, bases = self._markers()
        if not bases:
            return
        last = max(bases, key=lambda b: len(bases[b]))
        for base in set(bases) & set(bases[last]):
            files.remove(self.spark, f"{self.where}/bases/{base}")
        for batch in set(commits) & set(bases[last]):
            files.remove(self.spark, f"{self.where}/commits/{batch}")
        live = {last} | {f for b, f in commits.items() if b not in bases[last]}
        for folder in files.names(self.spark, f"{self.where}/data"):
            if folder not in live:
                files.remove(self.spark, f"{self.where}/data/{folder}")

    def follow(self, stream: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Adds the micro-batches of a stream of candidates until there are no new ones; a restart from the checkpoint repeats at most one batch by its name."""
        put = lambda rows, n: self.add(rows, f"{name}-{n}")
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
