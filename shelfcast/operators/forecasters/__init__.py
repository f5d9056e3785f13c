"""Forecast models over whole tables of series."""

from shelfcast.operators.forecasters.base import Forecaster
from shelfcast.operators.forecasters.decomposable import DecomposableForecaster
from shelfcast.operators.forecasters.function import FunctionForecaster
from shelfcast.operators.forecasters.naive import NaiveForecaster
from shelfcast.operators.forecasters.seasonal_arima import SeasonalArimaForecaster
from shelfcast.operators.forecasters.stateful import StatefulForecaster

# The names models are chosen by.
MODELS = {
    "prophet": DecomposableForecaster,
    "sarima": SeasonalArimaForecaster,
    "naive": NaiveForecaster,
}


def build_model(name: str) -> Forecaster:
    """A fresh model by name, in any case."""
    model = MODELS.get(name.lower())
    if model is None:
        raise ValueError(f"{name!r} is no model; there are {', '.join(MODELS)}")
    return model()


__all__ = [
    "MODELS",
    "DecomposableForecaster",
    "Forecaster",
    "FunctionForecaster",
    "NaiveForecaster",
    "SeasonalArimaForecaster",
    "StatefulForecaster",
    "build_model",
]
