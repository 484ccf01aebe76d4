"""What an export is asked to do, validated when it is made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators.tiling import check_sizes
from tilewright.schema import PIXEL_BYTES
from tilewright.sources import store

FILE = "_pipeline-config.json"
#: Functions that give a collection, of which no image can be computed (fixed values).
COLLECTIONS = frozenset({"ImageCollection.load", "Collection.filter", "Collection.map", "Collection.sort", "Collection.limit", "Collection.distinct", "Collection.flatten", "Collection.merge", "Collection.filterBounds", "Collection.filterDate", "Collection.filterMetadata"})


class InputError(ValueError):
    """All that is wrong with the arguments, in one message."""


@dataclass(frozen=True)
class ExportConfig:
    expression: str
    project: str
    output: str
    grid: dict
    tile_size: int = 512
    output_tile_size: int | None = None
    band_count: int = 1
    data_type: str = "float32"
    nodata: float | None = None
    compression: str = "deflate"
    merge: bool = False
    snapshot_time: int | None = None
    region: dict | None = None
    labels: dict = field(default_factory=dict)

    def __post_init__(self):
        wrong = []
        try:
            check_sizes(self.tile_size, self.output_tile_size)
        except ValueError as e:
            wrong.append(str(e))
        if self.band_count < 1:
            wrong.append("band_count must be at least 1")
        if self.data_type not in PIXEL_BYTES:
            wrong.append(f"data_type must be one of {', '.join(PIXEL_BYTES)}")
        if self.compression not in ("deflate", "none"):
            wrong.append("compression must be deflate or none")
        if (self.output_tile_size or self.tile_size) ** 2 * self.band_count * PIXEL_BYTES.get(self.data_type, 4) >= 1 << 31:
            wrong.append("an output tile must stay below 2 GiB")
        wrong += input_errors(self.expression, None, None)
        if wrong:
            raise InputError("; ".join(wrong))

    def write(self) -> None:
        """The configuration beside the output; fields without a value are left out."""
        store.put(self.output, FILE, json.dumps({k: v for k, v in asdict(self).items() if v is not None}, indent=1).encode())

    @staticmethod
    def read(output: str) -> ExportConfig:
        return ExportConfig(**json.loads(store.read(output if output.endswith(".json") else f"{output.rstrip('/')}/{FILE}")))


def dig(tree: object, *keys: object) -> object:
    """What stands at a path of nested objects; None where it breaks off."""
    for key in keys:
        tree = tree.get(key) if isinstance(tree, dict) and isinstance(key, str) else None
    return tree


def result_function(expression: str) -> str | None:
    """The name of the function that gives an expression's result, if its result is a function's."""
    tree = json.loads(expression)
    return dig(tree, "values", dig(tree, "result"), "functionInvocationValue", "functionName")


def result_function_column(expression: Column) -> Column:
    """The same of a column of expressions."""
    node = F.concat(F.lit("$.values."), F.get_json_object(expression, "$.result"), F.lit(".functionInvocationValue.functionName"))
    return F.call_function("get_json_object", expression, node)


def gives_collection(name: Column) -> Column:
    return F.coalesce(name.isin(*sorted(COLLECTIONS)), F.lit(False))


def input_errors(expression: str | None, region: dict | None, crs: str | None) -> list[str]:
    """Everything that is wrong with these inputs."""
    wrong = []
    if expression is not None:
        try:
            name = result_function(expression)
            if name in COLLECTIONS:
                wrong.append(f"{name} yields a collection and no image can be taken from it; end the expression with a reducer")
        except ValueError as e:
            wrong.append(f"expression is no JSON: {e}")
    for check, value in ((geo.polygons, region), (geo.epsg, crs)):
        if value is not None:
            try:
                check(value)
            except (ValueError, KeyError, TypeError, IndexError) as e:
                wrong.append(str(e))
    return wrong
