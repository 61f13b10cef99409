"""Detectors and session masking for SQL: Python table functions, for ``LATERAL`` and for tables that are partitioned by session.

    register(spark, Config(), plugins=(Mine,))
    SELECT id, d.* FROM texts, LATERAL detect_plugins(text) d
    SELECT * FROM mask_session(TABLE(turns) PARTITION BY conv_id ORDER BY turn)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from hushframe.config import Config
from hushframe.functions.detect import Detector
from hushframe.operators.mapping import Mapping
from hushframe.operators.mask import Masker
from hushframe.operators.plugins import plugin_spans

_SPAN = StructType().add("value", StringType()).add("category", StringType()).add("start_at", IntegerType()).add("end_at", IntegerType()).add("confidence", DoubleType())


def detect_plugins(plugins: Sequence):
    """A table function of one text: the valid matches of user detectors."""
    found = tuple(plugins)

    class DetectPlugins:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.isTable or not isinstance(text.dataType, StringType):
                raise ValueError("detect_plugins takes one text")
            return AnalyzeResult(_SPAN)

        def eval(self, text: str):
            for value, category, start, end, confidence in plugin_spans(text, found) if text else ():
                yield value, category, start, end, confidence

    return udtf(DetectPlugins)


def detect_personal_data(config: Config | None = None, plugins: Sequence = ()):
    """A table function of one text: all stages, resolved, without what is allowed."""
    config = config or Config()

    class DetectPersonalData:
        def __init__(self):
            self.detector = Detector(config, plugins)

        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.isTable or not isinstance(text.dataType, StringType):
                raise ValueError("detect_personal_data takes one text")
            return AnalyzeResult(_SPAN)

        def eval(self, text: str):
            for value, category, start, end, confidence in self.detector.analyze(text):
                yield value, category, start, end, confidence

    return udtf(DetectPersonalData)


def mask_session(config: Config | None = None, plugins: Sequence = (), column: str = "text"):
    """A table function of a table with a text column, for ``PARTITION BY`` session and ``ORDER BY``: its rows and ``masked``.

    One session's rows come one after the other and share a mapping; only it is held, not the rows.
    """
    config = config or Config()

    class MaskSession:
        def __init__(self):
            self.masker, self.mapping = Masker(config, plugins), Mapping(config.reversible)

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or column not in rows.dataType.fieldNames() or "masked" in rows.dataType.fieldNames():
                raise ValueError(f"mask_session takes a table with a column {column} and without one named masked")
            schema = StructType(list(rows.dataType.fields))
            return AnalyzeResult(schema.add("masked", StringType()))

        def eval(self, row):
            text = row[column]
            yield (*row, self.masker.mask(text, self.mapping)[0] if config.is_enabled else text)

    return udtf(MaskSession)


def register(spark: SparkSession, config: Config | None = None, plugins: Sequence = ()) -> None:
    """The three functions under their names, for SQL of this session."""
    spark.udtf.register("detect_plugins", detect_plugins(plugins))
    spark.udtf.register("detect_personal_data", detect_personal_data(config, plugins))
    spark.udtf.register("mask_session", mask_session(config, plugins))
