"""The declarative search: a filter object becomes one DataFrame.

All conditions are columns, so what can reach the scan does: the geographic box and
the dates are plain comparisons. Sorting, offset and limit come last and become one
bounded top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, time
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.functions import geo
from mediashoal.functions.dates import sort_ts
from mediashoal.functions.rules import is_listed, like

PAGE_DEFAULT, PAGE_MOST, FORM_PAGE = 100, 500, 120


@dataclass(frozen=True)
class SearchFilter:
    query: str | None = None
    media_type: str | None = None
    missing: bool | None = None
    from_ts: int | None = None
    to_ts: int | None = None
    camera: str | None = None
    person_id: int | None = None
    person_name: str | None = None
    has_gps: bool | None = None
    has_camera: bool | None = None
    lat: float | None = None
    lng: float | None = None
    radius_km: float | None = None
    sort_order: str | None = None
    limit: int | None = None
    offset: int | None = None

    @classmethod
    def from_form(cls, form: dict, tz: str = "UTC", page: int = 0) -> SearchFilter:
        """From a form's strings: empty is unset, dates are whole local days, a chosen
        region asks for coordinates."""
        zone = ZoneInfo(tz)

        def day(text: str | None, at: time) -> int | None:
            return int(datetime.combine(datetime.fromisoformat(text).date(), at, zone).timestamp()) if text else None

        region = geo.valid(form.get("lat"), form.get("lng"), form.get("radius_km"))
        return cls(
            query=form.get("query") or None, media_type=form.get("media_type") or None, missing=form.get("missing"), from_ts=day(form.get("from"), time(0, 0, 0)),
            to_ts=day(form.get("to"), time(23, 59, 59)), camera=form.get("camera") or None, person_id=form.get("person_id"), person_name=form.get("person_name") or None,
            has_gps=True if region else form.get("has_gps"), has_camera=form.get("has_camera"), lat=form.get("lat") if region else None, lng=form.get("lng") if region else None,
            radius_km=form.get("radius_km") if region else None, sort_order=form.get("sort_order") or None, limit=FORM_PAGE, offset=page * FORM_PAGE,
        )


def listed() -> Column:
    return is_listed(F.col("path"), F.col("file_name"), F.col("media_type"))


def conditions(f: SearchFilter, box: bool = True) -> list[Column]:
    """All but the person; each null result leaves the row out."""
    out = [listed()]
    if f.query and f.query.strip():
        q = f.query.strip()
        out.append(like(F.col("file_name"), q) | like(F.col("path"), q))
    if f.media_type is not None:
        out.append(F.col("media_type") == f.media_type)
    if f.missing is not None:
        out.append(F.col("missing") == f.missing)
    if f.from_ts is not None:
        out.append(sort_ts() >= f.from_ts)
    if f.to_ts is not None:
        out.append(sort_ts() <= f.to_ts)
    if f.camera is not None:
        out.append(like(F.concat("camera_make", F.lit(" "), "camera_model"), f.camera) | like(F.col("camera_model"), f.camera))
    if f.has_gps is not None:
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        out.append(both if f.has_gps else ~both)
    if f.has_camera is not None:
        either = F.col("camera_make").isNotNull() | F.col("camera_model").isNotNull()
        out.append(either if f.has_camera else ~either)
    if geo.valid(f.lat, f.lng, f.radius_km):
        out.append(geo.within(F.col("latitude"), F.col("longitude"), f.lat, f.lng, f.radius_km, box))
    return out


def of_person(media: DataFrame, faces: DataFrame, people: DataFrame, person_id: int | None = None, person_name: str | None = None) -> DataFrame:
    """Media with a face of the person; id and name must hold for the same face."""
    named = faces.where(F.col("person_id").isNotNull())
    if person_id is not None:
        named = named.where(F.col("person_id") == person_id)
    if person_name is not None:
        wanted = people.where(like(F.col("name"), person_name.strip())).select(F.col("id").alias("person_id"))
        named = named.join(wanted, "person_id", "left_semi")
    return media.join(named.select(F.col("media_item_id").alias("id")), "id", "left_semi")


def page(df: DataFrame, sort_order: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """By date and id in one direction; null dates are lowest."""
    up = (sort_order or "").lower() == "asc"
    keys = [sort_ts().asc_nulls_first(), F.col("id").asc()] if up else [sort_ts().desc_nulls_last(), F.col("id").desc()]
    n = min(max(PAGE_DEFAULT if limit is None else limit, 1), PAGE_MOST)
    return df.orderBy(*keys).offset(max(offset or 0, 0)).limit(n)


def page_after(df: DataFrame, last_ts: int | None, last_id: int, limit: int | None = None) -> DataFrame:
    """The page after a row of the descending order, without counting off rows."""
    ts = sort_ts()
    after = (ts.isNull() & (F.col("id") < last_id)) if last_ts is None else (ts < last_ts) | ((ts == last_ts) & (F.col("id") < last_id)) | ts.isNull()
    return page(df.where(after), "desc", limit)


def matching(media: DataFrame, f: SearchFilter, faces: DataFrame | None = None, people: DataFrame | None = None, box: bool = True) -> DataFrame:
    """All rows that match, neither sorted nor cut."""
    out = media
    for c in conditions(f, box):
        out = out.where(c)
    if f.person_id is not None or f.person_name is not None:
        out = of_person(out, faces, people, f.person_id, f.person_name)
    return out


def search_media(media: DataFrame, f: SearchFilter, faces: DataFrame | None = None, people: DataFrame | None = None, box: bool = True) -> DataFrame:
    return page(matching(media, f, faces, people, box), f.sort_order, f.limit, f.offset)


def get_media_item(media: DataFrame, item: int) -> DataFrame:
    return media.where(F.col("id") == item)


def processing_scope(media: DataFrame, images_only: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Not missing and listed; ids that match nothing are left out silently."""
    out = media.where(~F.col("missing")).where(listed())
    if images_only:
        out = out.where(F.col("media_type") == "image")
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")


def cleanup_scope(media: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Images that are not missing and, given a listing, are there now; by id."""
    out = processing_scope(media, images_only=True)
    if listing is not None:
        out = out.join(listing.select("path"), "path", "left_semi")
    return out.orderBy("id")


def map_points(media: DataFrame) -> DataFrame:
    """Images with coordinates, without the rule on folder names."""
    from mediashoal.functions.rules import is_face_tile

    return media.where((F.col("media_type") == "image") & ~F.col("missing") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).where(
        ~is_face_tile(F.col("file_name"), F.col("media_type"))
    )
