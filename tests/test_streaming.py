"""The streamed per-time counts give the same Kaplan-Meier curve as the batch job."""
from tenura.operators import survival as sv
from tenura.sources.panels import shipment_panel
from tenura.streaming.survival_stream import streamed_km
from tests.conftest import SF001


def test_streamed_km_equals_batch(spark):
    a = {r["t"]: (r["at_risk"], r["observed"], round(r["survival"], 12)) for r in streamed_km(spark, SF001).collect()}
    b = {r["t"]: (r["at_risk"], r["observed"], round(r["survival"], 12))
         for r in sv.kaplan_meier(shipment_panel(spark, SF001), "t", "e").collect()}
    assert a == b and len(a) > 10
