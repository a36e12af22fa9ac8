"""Names and small text forms: file names, scene ids, option strings, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the file-name formats of tiles
TRIPLET_NAME = "{triplet_id:05d}_{tile_type}"
CROP_NAME = "{i0:05d}_{j0:05d}"
SCENE_NAME = "{scene_id}"

#: fixed values: option keys read as integers, all others as floats
INTEGER_OPTIONS = ("min_cluster_size", "min_samples", "pca__n_components", "n_components")

_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def format_fields(fmt: str) -> list[tuple[str, str]]:
    """Fields of a name format with their Spark type (``d`` formats are long)."""
    return [(name, "long" if (spec or "").endswith("d") else "string") for name, spec in _FIELD.findall(fmt)]


def format_regex(fmt: str, ext: str | None = None) -> str:
    """Anchored regular expression with one group per field of ``fmt``."""
    out, pos = "^", 0
    for m in _FIELD.finditer(fmt):
        out += re.escape(fmt[pos : m.start()])
        out += r"([-+]?\d+)" if (m.group(2) or "").endswith("d") else "(.+?)"
        pos = m.end()
    out += re.escape(fmt[pos:])
    return out + (re.escape(f".{ext}") if ext else "") + "$"


def name_matches(name: Column, fmt: str, ext: str | None = None) -> Column:
    return name.rlike(format_regex(fmt, ext))


def parse_name(name: Column, fmt: str, ext: str | None = None) -> dict[str, Column]:
    """One typed column per field of ``fmt`` read out of ``name``."""
    regex = format_regex(fmt, ext)
    return {
        field: F.regexp_extract(name, regex, n + 1).cast(kind)
        for n, (field, kind) in enumerate(format_fields(fmt))
    }


def format_name(fmt: str, ext: str | None = None, **columns: Column | str) -> Column:
    """Build a name from columns by a ``{field:05d}`` style format."""
    pattern, args, pos = "", [], 0
    for m in _FIELD.finditer(fmt):
        pattern += fmt[pos : m.start()].replace("%", "%%")
        spec = m.group(2) or ""
        pattern += f"%{spec}" if spec else "%s"
        c = columns.get(m.group(1), m.group(1))
        args.append(F.col(c) if isinstance(c, str) else c)
        pos = m.end()
    pattern += fmt[pos:].replace("%", "%%") + (f".{ext}" if ext else "")
    return F.format_string(pattern, *args)


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def change_suffix(path: Column, old: str, new: str) -> Column:
    return F.regexp_replace(path, re.escape(old) + "$", new.replace("$", r"\$"))


def dataset_key(model_path: Column | str, data_path: Column | str) -> Column:
    """Key of stored embeddings: md5 of the model and data paths together."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in (model_path, data_path)]
    return F.md5(F.concat(*parts))


def letter(index: Column) -> Column:
    """0 -> A, 1 -> B, …"""
    return F.upper(F.char(index + F.lit(97)))


def parse_scene_id(
    scene_id: Column, pattern: str = r"^(.*?)__?(\d{8}_?\d{4,6})$", time_format: str = "yyyyMMdd_HHmm"
) -> tuple[Column, Column]:
    """(prefix, time) of a scene id; the layout is given by ``pattern``/``time_format``."""
    return (
        F.regexp_extract(scene_id, pattern, 1),
        F.to_timestamp_ntz(F.regexp_extract(scene_id, pattern, 2), F.lit(time_format)),
    )


def minutes(n: Column | int | float) -> Column:
    """Time span of ``n`` minutes."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def parse_kwargs(text: str | None) -> dict[str, int | float]:
    """``k=v,k=v`` into keyword arguments."""
    out: dict[str, int | float] = {}
    for item in (text or "").split(","):
        if item:
            key, value = item.split("=")
            out[key] = int(value) if key in INTEGER_OPTIONS else float(value)
    return out


def kwargs_map(text: Column) -> Column:
    """Column form of :func:`parse_kwargs`: ``map<string,double>``."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.cast("double"))


def transform_name(kind: str, **kwargs) -> str:
    """Output name of a transform: ``pca_transform__n_components_4``."""
    return "__".join([f"{kind}_transform"] + [f"{k}_{v}" for k, v in kwargs.items()])


def map_title(
    scene_id: Column, lat: Column, lon: Column, model: Column, nx: Column, ny: Column,
    resolution_km: Column, step: Column, kind: str, components: list[int],
) -> Column:
    """Four-line caption of a scene map."""
    return F.concat_ws(
        "\n",
        scene_id,
        F.concat(F.lit("(lat0, lon0)=("), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(")")),
        F.format_string(
            "%s NN model, %d x %d tiles at %.2fkm resolution, %d step (%.2fkm)",
            model, nx, ny, resolution_km, step, step * resolution_km,
        ),
        F.lit(f"prediction RGB from {kind} components [{', '.join(map(str, components))}]"),
    )
