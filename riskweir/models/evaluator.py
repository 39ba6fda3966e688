"""An MLlib evaluator for the exact metrics."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from riskweir.models.scoring import positive
from riskweir.operators.evaluate import metric_rows
from riskweir.schema import LABEL


class ExactEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Average Precision (default) or any of the other exact metrics, for ``CrossValidator`` and the like."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability vector column", TypeConverters.toString)
    metricName = Param(Params._dummy(), "metricName", "metric", TypeConverters.toString)

    @keyword_only
    def __init__(self, labelCol=LABEL, probabilityCol="probability", metricName="pr_auc"):
        super().__init__()
        self._setDefault(labelCol=LABEL, probabilityCol="probability", metricName="pr_auc")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        label = self.getOrDefault("labelCol")
        scored = dataset.select(label, positive(self.getOrDefault("probabilityCol")).alias("score"))
        return float(metric_rows(scored, label=label)[0][self.getOrDefault("metricName")])

    def isLargerBetter(self) -> bool:
        return True
