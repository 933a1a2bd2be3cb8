"""Model inference as an operator: Arrow batches through one cached session a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

_SESSIONS: dict[tuple, object] = {}


def session(path: str, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
    """The worker's session of a model file, opened once, one thread (tasks are the parallelism)."""
    if (path, providers) not in _SESSIONS:
        import onnxruntime as ort

        opt = ort.SessionOptions()
        opt.intra_op_num_threads = opt.inter_op_num_threads = 1
        opt.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        _SESSIONS[path, providers] = ort.InferenceSession(path, opt, providers=list(providers))
    return _SESSIONS[path, providers]


def infer(df: DataFrame, model: Callable[[pd.DataFrame], list], input_cols: list[str], keep: list[str], output: str, output_type: str, batch: int = 64) -> DataFrame:
    """Adds what ``model`` returns for batches of rows; other columns than ``keep`` are not read.

    ``model`` is any picklable callable from a frame of the input columns to a
    list of one value a row; :func:`onnx_model` makes one of a model file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = [pdf.iloc[i : i + batch] for i in range(0, len(pdf), batch)]
            out = pdf[keep].copy()
            values = [v for p in parts for v in model(p[input_cols])]
            if len(values) != len(pdf):
                raise ValueError("a model returns one value a row")
            out[output] = values
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*dict.fromkeys(keep + input_cols)).mapInPandas(run, f"{schema}, `{output}` {output_type}")


def onnx_model(file: str, shape: tuple[int, ...], dtype: str = "float32", hint: str = "") -> Callable[[pd.DataFrame], list]:
    """A callable for :func:`infer` from a file added with ``SparkContext.addFile``; flat arrays in and out."""

    def call(pdf: pd.DataFrame) -> list:
        s = session(SparkFiles.get(file))
        x = np.stack([np.asarray(v, dtype) for v in pdf.iloc[:, 0]]).reshape(len(pdf), *shape)
        names = [o.name for o in s.get_outputs()]
        out = s.run([resolve_output(names, hint)], {s.get_inputs()[0].name: x})[0]
        return [row.ravel().tolist() for row in out.reshape(len(pdf), -1)]

    return call


def resolve_output(names: list[str], hint: str) -> str:
    """The output called ``hint``, else the first whose name contains it, else the first."""
    if not names:
        raise ValueError("the model has no output")
    return next((n for n in names if n == hint), next((n for n in names if hint and hint.lower() in n.lower()), names[0]))
