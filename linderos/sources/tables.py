"""Input tables of one validation run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import OPTIONAL, TABLES
from .r1 import R1_VIEW, registry_numbers

# Short names, with key columns renamed so that joined frames have no clashes.
_SHORT = {
    "predio": ("cca_predio", {"T_Id": "predio_id"}),
    "terreno": ("cca_terreno", {"T_Id": "terreno_id"}),
    "unidad": ("cca_unidadconstruccion", {"T_Id": "unidad_id"}),
    "caracteristica": ("cca_caracteristicaucons", {"T_Id": "caracteristica_id"}),
    "derecho": ("cca_derechocatastral", {"T_Id": "derecho_id"}),
    "interesado": ("cca_interesado", {"T_Id": "interesado_id"}),
    "agrupacion": ("cca_agrupacioninteresados", {"T_Id": "agrupacion_id"}),
    "miembro": ("cca_interesado_agrupacion", {"agrupacion": "miembro_agrupacion", "interesado": "miembro_interesado"}),
    "fuente": ("cca_fuenteadministrativa", {"T_Id": "fuente_id"}),
    "novedad": ("cca_estructuranovedadnumeropredial", {"T_Id": "novedad_id", "cca_predio_novedad_numero_predial": "predio"}),
    "r1": ("_r1_predios", {"numero_predial": "r1_numero"}),
    "vertices": ("uc_vertices", {}),
}


class MissingTable(LookupError):
    """A rule needs a table that was not given."""


def _casts(df: DataFrame, table: str) -> dict[str, tuple[str, Column | None]]:
    """Per declared column: the actual name, and the cast it needs if its type differs."""
    present = {c.lower(): c for c in df.columns}
    kinds = dict(df.dtypes)
    found = {}
    for field in (*TABLES[table].fields, *(OPTIONAL[table].fields if table in OPTIONAL else ())):
        actual = present.get(field.name.lower())
        if actual is not None:
            same = kinds[actual] == field.dataType.simpleString()
            found[field.name] = actual, None if same else F.col(f"`{actual}`").try_cast(field.dataType)
    return found


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns of a table in their declared types, and every other column as it is."""
    casts = _casts(df, table)
    declared = [(F.col(f"`{actual}`") if cast is None else cast).alias(name) for name, (actual, cast) in casts.items()]
    known = {actual for actual, _ in casts.values()}
    return df.select(*declared, *[F.col(f"`{c}`") for c in df.columns if c not in known])


class Cadastre:
    """The tables of a run: those of the schema under short names, and any others for user rules."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame]):
        self.spark = spark
        self.given = dict(frames)
        self.frames = {name: conform(df, name) if name in TABLES else df for name, df in frames.items() if name != R1_VIEW}
        if R1_VIEW in frames:
            # A list that comes as a table is held to the same as one that comes as a file: stripped, not blank, distinct.
            self._registry = registry_numbers(frames[R1_VIEW])
            self.frames[R1_VIEW] = self._registry.numbers
        self.kept: dict[str, DataFrame] = {}  # relations written for a run, by name
        self.by_key = False  # frames are read from the kept relations
        self.traits = self.drawn = True  # the kept units have their traits, their drawn area
        self.hot: frozenset[str] = frozenset()  # counts of children that one parcel has too many of
        self._short: dict[str, DataFrame] = {}

    def has(self, short: str) -> bool:
        return _SHORT[short][0] in self.frames

    def __getitem__(self, short: str) -> DataFrame:
        table, names = _SHORT[short]
        if table not in self.frames:
            raise MissingTable(table)
        if short not in self._short:
            df = self.frames[table]
            # Declared columns only: other ones could clash when frames are joined.
            known = (*TABLES[table].names, *(OPTIONAL[table].names if table in OPTIONAL else ()))
            self._short[short] = df.select(*[name for name in known if name in df.columns]).withColumnsRenamed(names)
        return self._short[short]

    def registry_rows(self) -> DataFrame:
        """The registry list with its repeats, for uses that aggregate it anyway."""
        self["r1"]
        return self._registry.rows.withColumnsRenamed(_SHORT["r1"][1])

    def with_r1(self, numbers: DataFrame | None) -> "Cadastre":
        """The same tables with another registry list, or with none."""
        frames = {name: df for name, df in self.given.items() if name != R1_VIEW}
        if numbers is not None:
            frames[R1_VIEW] = numbers
        return Cadastre(self.spark, frames)

    def lost_cells(self) -> dict[str, int]:
        """Cells that are not NULL but have no value of the declared type, by table.column; one pass over each table
        that needs a cast, none over others."""
        lost = {}
        for table, df in self.given.items():
            casts = _casts(df, table) if table in TABLES and table != R1_VIEW else {}
            counted = [
                F.count(F.when(F.col(f"`{actual}`").isNotNull() & cast.isNull(), 1)).alias(name)
                for name, (actual, cast) in casts.items() if cast is not None
            ]
            if counted:
                lost |= {f"{table}.{name}": n for name, n in df.agg(*counted).head().asDict().items() if n}
        return lost

    def register_views(self) -> None:
        """Temp views under the original table names, for rules written in SQL."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)

    def drop_views(self) -> None:
        for name in self.frames:
            self.spark.catalog.dropTempView(name)


def load_tables(spark: SparkSession, location: str, format: str = "parquet", others: Iterable[str] = (), **options) -> Cadastre:
    """Tables stored as `location/<table>` in any file format Spark reads; `others` names tables beyond the schema."""
    frames = {}
    for name in (*TABLES, *others):
        try:
            frames[name] = spark.read.format(format).options(**options).load(f"{location.rstrip('/')}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND" or name not in TABLES:
                raise
    return Cadastre(spark, frames)


def load_catalog(spark: SparkSession, database: str) -> Cadastre:
    """All tables of a catalog schema."""
    names = [table.name for table in spark.catalog.listTables(database) if not table.isTemporary]
    known = {name.lower(): name for name in TABLES}
    return Cadastre(spark, {known.get(name.lower(), name): spark.table(f"{database}.`{name}`") for name in names})
