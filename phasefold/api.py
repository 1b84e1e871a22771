"""The operators under the names that users of such libraries know."""

from .functions.metrics import compute_error as ComputeError
from .operators.ccm import ccm as CCM
from .operators.embed import embed as Embed
from .operators.multiview import multiview as Multiview
from .operators.projection import simplex as Simplex
from .operators.projection import smap as SMap
from .operators.surrogate import surrogate_data as SurrogateData
from .plans.matrices import ccm_matrix as CCM_Matrix
from .plans.matrices import cross_map_column_list as CrossMap_ColumnList
from .plans.matrices import cross_map_columns as CrossMap_Columns
from .plans.matrices import cross_map_matrix as CrossMap_Matrix
from .plans.matrices import embed_dim_columns as EmbedDim_Columns
from .plans.sweeps import embed_dimension as EmbedDimension
from .plans.sweeps import predict_interval as PredictInterval
from .plans.sweeps import predict_nonlinear as PredictNonlinear
from .plans.sweeps import smap_theta as SMap_theta
from .plans.sweeps import smap_tp as SMap_Tp

from .sources.io import SAMPLES, sample

#: one table at a time serves wide tables too, as columns are gathered one by one
EDimColsBlock = EmbedDim_Columns


def Examples(spark) -> dict:
    """One result per operator on the samples."""
    from .examples import examples

    return examples(spark)


def sampleData(spark) -> dict:
    """The computed samples by name."""
    return {name: sample(spark, name) for name in SAMPLES}


def MakeBlock(*_, **__):
    """Gone; Embed does it."""
    raise ValueError("MakeBlock is gone: use Embed")


__all__ = [
    "CCM", "CCM_Matrix", "EDimColsBlock", "Examples", "sampleData", "ComputeError", "CrossMap_ColumnList", "CrossMap_Columns", "CrossMap_Matrix", "Embed", "EmbedDimension",
    "EmbedDim_Columns", "MakeBlock", "Multiview", "PredictInterval", "PredictNonlinear", "SMap", "SMap_Tp", "SMap_theta", "Simplex", "SurrogateData",
]
