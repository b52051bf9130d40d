"""Pipelines of named steps on Spark ML: fitted, applied, saved and loaded like any ML pipeline."""

from __future__ import annotations

import importlib
import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


class FrameStep(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """An operator of this package, from a table to a table, as a step: its dotted name and arguments that JSON can hold."""

    operator = Param(Params._dummy(), "operator", "module.function of lumenframe.operators", TypeConverters.toString)
    arguments = Param(Params._dummy(), "arguments", "keyword arguments as JSON", TypeConverters.toString)
    name = Param(Params._dummy(), "name", "name of the step's output", TypeConverters.toString)

    @keyword_only
    def __init__(self, operator: str = "", arguments: str = "{}", name: str = ""):
        super().__init__()
        self._set(operator=operator, arguments=arguments, name=name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        module, function = self.getOrDefault("operator").split(".")
        found = importlib.import_module(f"lumenframe.operators.{module}")
        return getattr(found, function)(dataset, **json.loads(self.getOrDefault("arguments")))


def step(name: str, operator: str, **arguments) -> FrameStep:
    """``operator`` is module.function under lumenframe.operators; its first argument is the table."""
    return FrameStep(operator=operator, arguments=json.dumps(arguments), name=name)


def make_pipeline(*steps: FrameStep | Transformer | Estimator) -> Pipeline:
    return Pipeline(stages=list(steps))


def outputs(model: PipelineModel, df: DataFrame) -> dict[str, DataFrame]:
    """The table after each step, by its name (or its uid, for steps that are no FrameStep); nothing is computed until used."""
    found = {}
    for s in model.stages:
        df = s.transform(df)
        found[s.getOrDefault("name") if isinstance(s, FrameStep) else s.uid] = df
    return found
