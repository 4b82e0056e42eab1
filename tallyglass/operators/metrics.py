"""Named business measures as executable expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators import lexical


@dataclass(frozen=True)
class Metric:
    """A measure: what it is called, the aggregate that computes it, and the words it may be asked for by."""

    name: str
    aggregate: str
    meaning: str
    words: tuple[str, ...] = ()

    @property
    def terms(self) -> str:
        """Text that questions are matched against: the name's parts, the other words, the meaning."""
        return " ".join([*self.name.split("_"), *self.words, self.meaning])


@dataclass(frozen=True)
class MetricLayer:
    """Metrics over one (joined) frame plus descriptions of its columns."""

    metrics: tuple[Metric, ...]
    columns: dict[str, str] = field(default_factory=dict)

    def validate(self, df: DataFrame) -> list[str]:
        """Problems found by analysis alone; nothing is executed."""
        present = {x.lower() for x in df.columns}
        problems = [f"{c} is described but absent" for c in self.columns if c.rpartition(".")[2].lower() not in present]
        for m in self.metrics:
            try:
                df.agg(F.expr(m.aggregate)).schema  # noqa: B018
            except AnalysisException as e:
                problems.append(f"{m.name} can't be computed here ({e.getCondition() or 'analysis failed'})")
        return problems

    def compute(self, df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
        known = {m.name: m for m in self.metrics}
        return df.groupBy(*by).agg(*[F.expr(known[n].aggregate).alias(n) for n in names])

    def annotate(self, catalog: DataFrame) -> DataFrame:
        spark = catalog.sparkSession
        notes = spark.createDataFrame([tuple(k.split(".", 1)) + (v,) for k, v in self.columns.items()],
                                      "table string, column string, description string")
        return catalog.join(notes, ["table", "column"], "left")

    def relevant(self, questions: DataFrame, qkey: str, qtext: str, k: int = 3) -> DataFrame:
        """query, metric, rank: the best matching definitions with a positive score."""
        spark = questions.sparkSession
        docs = spark.createDataFrame([(i, m.terms) for i, m in enumerate(self.metrics)],
                                     "id int, text string")
        names = spark.createDataFrame([(i, m.name) for i, m in enumerate(self.metrics)], "doc int, metric string")
        best = lexical.top_k(lexical.build(docs, "id", "text"), questions, qkey, qtext, k)
        return best.join(names, "doc").select("query", "metric", "rank")


SALES = MetricLayer(
    metrics=(
        Metric("revenue", "sum(l_extendedprice * (1 - l_discount))", "Money received for items sold, after discount", ("sales", "earned", "income", "turnover")),
        Metric("units_sold", "sum(l_quantity)", "Number of items sold", ("quantity", "bought", "units")),
        Metric("average_discount", "avg(l_discount)", "Mean discount per line", ("rebate", "markdown")),
        Metric("return_rate", "count_if(l_returnflag = 'R') / count(*)", "Share of lines that came back", ("returned", "refunds")),
    ),
    columns={"lineitem.l_extendedprice": "Price of the line before discount", "lineitem.l_discount": "Discount as a share of the price",
             "orders.o_totalprice": "Order amount as billed", "customer.c_acctbal": "Account balance of the customer"},
)
