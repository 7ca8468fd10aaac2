"""Specifications of feature representations and their compilation into DataFrame pipelines."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.operators import pixels, shape


class CompilationError(ValueError):
    """A specification that can't be compiled."""


def _plain(value: object) -> bool:
    if isinstance(value, dict):
        return all(isinstance(k, str) and _plain(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return all(map(_plain, value))
    return value is None or isinstance(value, (str, int, bool)) or (isinstance(value, float) and math.isfinite(value))


def _frozen(value: object) -> object:
    """A copy that can't be changed: maps become read-only views of their own copies, lists tuples."""
    if isinstance(value, dict):
        return MappingProxyType({k: _frozen(v) for k, v in value.items()})
    return tuple(map(_frozen, value)) if isinstance(value, (list, tuple)) else value


def _thawed(value: object) -> object:
    if isinstance(value, MappingProxyType):
        return {k: _thawed(v) for k, v in value.items()}
    return list(map(_thawed, value)) if isinstance(value, tuple) else value


@dataclass(frozen=True)
class OperatorSpec:
    name: str
    params: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"bad operator name {self.name!r}")
        if not isinstance(self.params, dict) or not _plain(self.params):
            raise ValueError("parameters must be a map of plain JSON values")
        object.__setattr__(self, "params", _frozen(self.params))

    def as_dict(self) -> dict:
        return {"name": self.name, "params": _thawed(self.params)}

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"), allow_nan=False)


@dataclass(frozen=True)
class RepresentationSpec:
    """A named hypothesis with its operators in order."""

    name: str
    hypothesis: str
    operators: tuple[OperatorSpec, ...]
    prediction: str
    falsification: str

    def __post_init__(self) -> None:
        for key in ("name", "hypothesis", "prediction", "falsification"):
            if not isinstance(getattr(self, key), str) or not getattr(self, key).strip():
                raise ValueError(f"{key} must not be blank")
        object.__setattr__(self, "operators", tuple(self.operators))
        if not self.operators:
            raise ValueError("a representation needs an operator")

    def to_json(self) -> str:
        body = {k: getattr(self, k) for k in ("name", "hypothesis", "prediction", "falsification")}
        return json.dumps(body | {"operators": [o.as_dict() for o in self.operators]}, sort_keys=True, separators=(",", ":"), allow_nan=False)

    def spec_hash(self) -> str:
        """Identity of the whole specification, names and prose too."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def representation_hash(self) -> str:
        """Identity of the operators alone, in any order."""
        return hashlib.sha256("\n".join(sorted(o.to_json() for o in self.operators)).encode()).hexdigest()

    @classmethod
    def from_json(cls, text: str) -> RepresentationSpec:
        """Strict: exactly the known keys."""
        body = json.loads(text)
        if not isinstance(body, dict) or set(body) != {"name", "hypothesis", "operators", "prediction", "falsification"} or not isinstance(body["operators"], list):
            raise ValueError("a specification has exactly name, hypothesis, operators, prediction and falsification")
        for o in body["operators"]:
            if not isinstance(o, dict) or set(o) != {"name", "params"}:
                raise ValueError("an operator has exactly name and params")
        return cls(**body | {"operators": tuple(OperatorSpec(**o) for o in body["operators"])})


_COLUMNS: dict[str, tuple[int, Callable[[Column], Column]]] = {"raw_pixels": (784, pixels.raw_pixels), "spatial": (3, pixels.spatial), "symmetry": (2, pixels.symmetry)}
_CONTROLS = {"downsampled": (196, pixels.downsampled)}
_CONTROL_HOG = ("hog", 1296)
_HISTOGRAMS = {"stroke_direction": (8, shape.direction_histogram), "direction_transition": (64, shape.transition_histogram), "curvature": (8, shape.curvature_histogram)}


class FeaturePipeline:
    """Operators in order; ``transform`` adds ``features``, their values one after another.

    All structural operators of a threshold share one Arrow pass over the images; nothing is shuffled."""

    def __init__(self, operators: Sequence[OperatorSpec], controls: bool = False):
        self._operators = list(operators)
        known = _COLUMNS | (_CONTROLS if controls else {})
        if not self._operators:
            raise CompilationError("no operators")
        self.dims: list[int] = []
        for o in self._operators:
            allowed = {"threshold"} if o.name == "topology" else set()
            hog = controls and o.name == _CONTROL_HOG[0]
            if o.name not in known and o.name not in _HISTOGRAMS and o.name != "topology" and not hog:
                raise CompilationError(f"unknown operator {o.name!r}")
            if set(o.params) - allowed:
                raise CompilationError(f"{o.name} doesn't take {sorted(set(o.params) - allowed)}")
            t = o.params.get("threshold", 0.5)
            if isinstance(t, bool) or not isinstance(t, (int, float)) or not 0 < t < 1:
                raise CompilationError("threshold must be between 0 and 1")
            self.dims.append(4 if o.name == "topology" else _CONTROL_HOG[1] if hog else (known | _HISTOGRAMS)[o.name][0])
        self.feature_dim = sum(self.dims)
        self._known = known

    def transform(self, images: DataFrame) -> DataFrame:
        df = images.withColumn("pixels", pixels.checked(F.col("pixels")))
        passes: dict[float, str] = {}
        parts: list[Column] = []
        for o in self._operators:
            if o.name in self._known:
                parts.append(self._known[o.name][1](F.col("pixels")))
                continue
            if o.name == _CONTROL_HOG[0]:
                df = df.withColumn("_hog", shape.hog_of(F.col("pixels")))
                parts.append(F.col("_hog"))
                continue
            t = float(o.params.get("threshold", 0.5))
            if t not in passes:
                passes[t] = f"_shape{len(passes)}"
                df = df.withColumn(passes[t], shape.shape_of(F.col("pixels"), t))
            found = F.col(passes[t])
            parts.append(shape.topology(found) if o.name == "topology" else _HISTOGRAMS[o.name][1](found["paths"]))
        features = F.concat(*parts)
        sound = (F.size(features) == self.feature_dim) & ~F.exists(features, lambda x: F.isnan(x) | x.isNull())
        return df.select(*images.columns, F.when(sound, features).otherwise(F.raise_error(F.lit("features must be finite and of the declared size"))).alias("features"))


class SharedPlan:
    """One pipeline for several lists of operators: each distinct operator is computed once, and a list's features are
    slices of the wide vector, at ``places``."""

    def __init__(self, lists: Sequence[Sequence[OperatorSpec]], controls: bool = False):
        at: dict[tuple[str, float], tuple[int, int]] = {}
        distinct: list[OperatorSpec] = []
        self.places: list[tuple[int, ...]] = []
        for operators in lists:
            own = FeaturePipeline(operators, controls)  # names what can't be compiled
            for o, dim in zip(operators, own.dims):
                if self._key(o) not in at:
                    at[self._key(o)] = (sum(d for _, d in at.values()), dim)
                    distinct.append(o)
            self.places.append(tuple(p for o in operators for p in range(at[self._key(o)][0], sum(at[self._key(o)]))))
        self._pipeline = FeaturePipeline(distinct, controls)

    @staticmethod
    def _key(o: OperatorSpec) -> tuple[str, float]:
        return o.name, float(o.params.get("threshold", 0.5))

    def transform(self, images: DataFrame) -> DataFrame:
        """``images`` with the wide vector as ``features``."""
        return self._pipeline.transform(images)

    def sliced(self, k: int) -> Column:
        """The features of list ``k`` from the wide vector."""
        return F.transform(F.array(*map(F.lit, self.places[k])), lambda p: F.get("features", p))


def compile_spec(spec: RepresentationSpec) -> FeaturePipeline:
    try:
        return FeaturePipeline(spec.operators)
    except ValueError as e:
        raise CompilationError(f"cannot compile {spec.name!r}: {e}") from e


def seed_specs() -> tuple[RepresentationSpec, ...]:
    """Five hand-made specifications to start a search from."""
    made = {"pixels": ("raw_pixels",), "topology": ("topology",), "layout": ("topology", "spatial"), "bends": ("topology", "curvature"), "strokes": ("topology", "stroke_direction", "curvature")}
    return tuple(RepresentationSpec(k, f"{k} tell classes apart", tuple(map(OperatorSpec, v)), "accuracy rises", "accuracy doesn't rise") for k, v in made.items())
