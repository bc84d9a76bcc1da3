"""A program run over frames of raw records: the same plan for batches and for each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import Output, Program
from millrace.operators import metrics
from millrace.operators.keysets import capture, key_name, tag
from millrace.plans.steps import run_steps
from millrace.schema import ALIVE, ORDER, SOURCE, keep
from millrace.session import compile_in_pieces
from millrace.sources.syslog import MALFORMED, input_counts, parse

TAG = "_mr_tag"
#: The number of the input a record came through, in frames of all inputs.
INPUT = "_mr_input"


@dataclass
class Result:
    """What a run gives. All are plans: nothing runs until they are used."""

    program: Program
    parsed: DataFrame | None
    #: All records after the program, dropped ones included.
    records: DataFrame

    def passed(self) -> DataFrame:
        return keep(self.records, F.col(ALIVE))

    def events(self, output: Output) -> DataFrame:
        from millrace.sinks.events import serialize

        return serialize(self.passed(), self.program.schema, output)

    def _keys(self) -> list[str]:
        return [key_name(k) for k in (*self.program.orchestration.keys, *self.program.metric_keys)]

    def process_counts(self) -> DataFrame:
        return self._named(metrics.process_counts(self.records, self._keys()))

    def label_counts(self) -> DataFrame:
        return self._named(metrics.label_counts(self.records, self._keys()))

    def input_counts(self) -> DataFrame:
        return input_counts(self.parsed)

    def _named(self, df: DataFrame) -> DataFrame:
        for k in (*self.program.orchestration.keys, *self.program.metric_keys):
            df = df.withColumnRenamed(key_name(k), f"key_{k}")
        return df


def run(program: Program, raw: DataFrame | Sequence[DataFrame], *, tag_override: str | None = None, seen: dict[int, DataFrame] | None = None, marks: bool = False) -> Result:
    """``raw`` has (source, order, record), as framing gives it: one frame per input of the program, or a single one for a program with one input.

    A frame with the column `_mr_input` holds records of all inputs, by their number. Sources of different inputs have different names.
    """
    if isinstance(raw, DataFrame):
        raws = [raw.filter(F.col(INPUT) == i).drop(INPUT) for i in range(len(program.inputs))] if INPUT in raw.columns else [raw]
    else:
        raws = list(raw)
    if len(raws) != len(program.inputs):
        raise ValueError(f"{len(program.inputs)} inputs need as many frames, not {len(raws)}")
    all_parsed, all_records = [], []
    for source, frame in zip(program.inputs, raws):
        parsed = parse(frame, program.schema, source.levels)
        ok = keep(parsed, F.col(MALFORMED).isNull()).drop(MALFORMED, "record")
        all_parsed.append(parsed)
        # What an extraction drops is gone before anything counts it.
        all_records.append(keep(run_steps(ok, source.extractions, program.schema, (), (SOURCE, ORDER)), F.col(ALIVE)))
    joined = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return transform(program, joined(all_records), parsed=joined(all_parsed), tag_override=tag_override, seen=seen, marks=marks)


def transform(program: Program, extracted: DataFrame, *, parsed: DataFrame | None = None, tag_override: str | None = None, seen: dict[int, DataFrame] | None = None, marks: bool = False) -> Result:
    """The part of a run after extraction; ``extracted`` are records as `start_records` makes them, with source and order."""
    compile_in_pieces(extracted.sparkSession)
    keys = program.orchestration.keys
    held = capture(extracted, tuple(dict.fromkeys((*keys, *program.metric_keys))))
    tagged = held.withColumn(TAG, F.lit(tag_override) if tag_override is not None else tag(program.orchestration))
    records = run_steps(tagged, program.transformations, program.schema, tuple(key_name(k) for k in keys), (SOURCE, ORDER), seen, marks)
    return Result(program, parsed, records)
