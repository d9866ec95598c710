"""Model-based signal analysis on ordered Spark tables: windowed least-squares fits of linear state-space models."""

from .operators.estimator import Estimator, create_rls
from .operators.nd import NDEstimator
from .plans.costs import TSLM, CompositeCost, ConstrainMatrix, CostSegment, NDCompositeCost
from .plans.gram import WConditionNumberWarning
from .plans.models import Alssm, AlssmExp, AlssmPoly, AlssmPolyJordan, AlssmPolyLegendre, AlssmPolyMeixner, AlssmProd, AlssmSin, AlssmStacked, AlssmStackedSO, AlssmSum, ModelBase
from .plans.segments import Segment

__all__ = [
    "TSLM",
    "Alssm",
    "AlssmExp",
    "AlssmPoly",
    "AlssmPolyJordan",
    "AlssmPolyLegendre",
    "AlssmPolyMeixner",
    "AlssmProd",
    "AlssmSin",
    "AlssmStacked",
    "AlssmStackedSO",
    "AlssmSum",
    "CompositeCost",
    "ConstrainMatrix",
    "CostSegment",
    "Estimator",
    "ModelBase",
    "NDCompositeCost",
    "NDEstimator",
    "Segment",
    "WConditionNumberWarning",
    "create_rls",
    "test",
]


def test(*args: str) -> int:
    """Run the tests beside the package."""
    from pathlib import Path

    import pytest

    return int(pytest.main([str(Path(__file__).parent.parent / "tests"), "-q", *args]))
