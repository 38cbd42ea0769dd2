"""Findings of changing files: a stream of file versions in, the findings that come and go out.

State is keyed by path: the last version seen and its findings. A newer version retracts the findings that it no longer has and
adds those that are new; an older one, or the same again, changes nothing. A version without content is a deletion: all
findings are retracted. State and source positions are in the checkpoint, so a restarted query goes on where it was. A
path's state is as large as its findings; texts are not kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import entropy, regex_rules

FINDING = ["rule_id", "level", "line_no", "message"]
CHANGE = "path string, version bigint, change string, rule_id string, level string, line_no int, message string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def findings(files: DataFrame) -> DataFrame:
    """path, version and FINDING of each version of a file (path, version, content): those of the line rules and the entropy check,
    and one row without a finding for the version itself."""
    files = files.select("path", F.col("version").cast("long").alias("version"), "content")
    lines = regex_rules.lines(files)
    columns = ["path", "version", *FINDING]
    none = files.select("path", "version", *(F.lit(None).cast(t).alias(c) for c, t in zip(FINDING, ("string", "string", "int", "string"), strict=True)))
    return none.unionByName(regex_rules.scan_lines(lines).select(*columns)).unionByName(entropy.secrets(lines).select(*columns))


class Differ(StatefulProcessor):
    """What a path's versions change, in order of version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version bigint, findings string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, set[tuple]] = {}
        for part in rows:
            for version, *finding in part[["version", *FINDING]].itertuples(index=False):
                own = new.setdefault(int(version), set())
                if isinstance(finding[0], str):
                    own.add((finding[0], finding[1], int(finding[2]), finding[3]))
        last, held = -1, set()
        if self.seen.exists():
            version, text = self.seen.get()
            last, held = version, {tuple(f) for f in json.loads(text)}
        out = []
        for version in sorted(v for v in new if v > last):
            for change, some in (("retracted", held - new[version]), ("added", new[version] - held)):
                out += [(key[0], version, change, *f) for f in sorted(some)]
            last, held = version, new[version]
        self.seen.update((last, json.dumps(sorted(held))))
        yield pd.DataFrame(out, columns=["path", "version", "change", *FINDING]).astype({"version": "int64", "line_no": "int32"})

    def close(self) -> None:
        pass


def changes(files: DataFrame) -> DataFrame:
    """CHANGE rows of a stream of file versions (path, version, content; versions from 0 on). Null paths are passed over."""
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = findings(files.filter("path IS NOT NULL AND version >= 0"))
    return rows.groupBy("path").transformWithStateInPandas(Differ(), CHANGE, "append", "none")


def start(files: DataFrame, out: str, checkpoint: str):
    """Appends the changes to Parquet in ``out``."""
    return changes(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
