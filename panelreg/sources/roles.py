"""The role schema: which columns are numbers, which are categories, which stay out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame, functions as F

from panelreg.functions.typing import to_level, to_number

# Names the survey tables use.
HOUSEHOLD_ID = "ma_ho"
YEAR_COLUMN = "survey_year"
YEAR_FEATURE = "year"
DEFAULT_TARGET = "AgrInc"
GROUP_COLUMNS = ("Kinh", "tinh")
GEOGRAPHY = {
    "none": (),
    "province": ("tinh",),
    "district": ("tinh", "quan"),
    "commune": ("tinh", "quan", "xa"),
}
ROLES = ("numeric", "categorical_binary", "categorical_ordinal")
RELATED_INCOME = {
    "AgrInc": ("TotalInc", "Wage", "CropInc", "CropValue"),
    "CropInc": ("TotalInc", "Wage", "AgrInc", "CropValue"),
}
OTHER_RELATED_INCOME = ("TotalInc", "Wage")


@dataclass(frozen=True)
class RoleSchema:
    numeric: tuple[str, ...] = ()
    categorical_binary: tuple[str, ...] = ()
    categorical_ordinal: tuple[str, ...] = ()

    @classmethod
    def from_mapping(cls, mapping: dict | None) -> "RoleSchema":
        mapping = mapping or {}
        return cls(**{role: tuple(mapping.get(role) or ()) for role in ROLES})

    @classmethod
    def from_yaml(cls, path: str) -> "RoleSchema":
        with open(path, encoding="utf-8") as stream:
            return cls.from_mapping(yaml.safe_load(stream))

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.categorical_binary + self.categorical_ordinal

    @property
    def columns(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def role_of(self, column: str) -> str:
        return next(role for role in ROLES if column in getattr(self, role))


@dataclass(frozen=True)
class FeatureColumns:
    """What a run uses: numeric and category columns in schema order, and what was left out."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    missing: tuple[str, ...] = field(default=())
    excluded: tuple[str, ...] = field(default=())

    @property
    def all(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def with_categorical(self, *columns: str) -> "FeatureColumns":
        new = tuple(c for c in columns if c not in self.categorical)
        return replace(self, categorical=self.categorical + new)


def related_columns(target: str, exclude_related: bool) -> tuple[str, ...]:
    """Columns that must not become features: the id, and on request the leaking incomes."""
    if not exclude_related:
        return (HOUSEHOLD_ID,)
    return (HOUSEHOLD_ID, *RELATED_INCOME.get(target, OTHER_RELATED_INCOME))


def geography_columns(level: str) -> tuple[str, ...]:
    if level not in GEOGRAPHY:
        raise ValueError(f"unknown geography level {level!r}, expected one of {', '.join(GEOGRAPHY)}")
    return GEOGRAPHY[level]


def select_features(
    columns: list[str],
    roles: RoleSchema,
    target: str,
    *,
    exclude_related: bool = False,
    geography: str | None = None,
    year_feature: bool = False,
) -> FeatureColumns:
    """Resolve the schema against the columns a table really has.

    ``geography`` None leaves area columns to the schema; a level adds exactly that level's
    columns and removes the finer ones. ``year_feature`` adds the survey year as a category.
    """
    banned = (*related_columns(target, exclude_related), target)
    usable = [c for c in roles.columns if c in columns and c not in banned]
    categorical = [c for c in roles.categorical if c in usable]
    if geography is not None:
        kept = geography_columns(geography)
        areas = GEOGRAPHY["commune"]
        categorical = [c for c in categorical if c not in areas or c in kept]
        categorical += [c for c in kept if c in columns and c not in categorical and c not in banned]
    if year_feature:
        categorical.append(YEAR_FEATURE)
    return FeatureColumns(
        numeric=tuple(c for c in roles.numeric if c in usable),
        categorical=tuple(categorical),
        missing=tuple(c for c in roles.columns if c not in columns and c not in banned),
        excluded=tuple(c for c in roles.columns if c in banned),
    )


def cast_roles(df: DataFrame, roles: RoleSchema, *, numbers: tuple[str, ...] = (), levels: tuple[str, ...] = ()) -> DataFrame:
    """Type the columns by role in one projection; columns outside the schema pass through."""
    types = {f.name: f.dataType for f in df.schema.fields}
    typed = {c: to_number(F.col(c), types[c]) for c in (*roles.numeric, *numbers) if c in types}
    typed |= {c: to_level(F.col(c), types[c]) for c in (*roles.categorical, *levels) if c in types}
    return df.withColumns(typed) if typed else df
