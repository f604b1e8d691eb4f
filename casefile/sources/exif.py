"""EXIF tags of JPEG files, read from the bytes: no image library is needed."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import map_link

#: Names of the tags of interest, by number.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA405: "FocalLengthIn35mmFilm", 0xA434: "LensModel", 0xA432: "LensSpecification",
    0x013C: "HostComputer", 0x9286: "UserComment", 0xA001: "ColorSpace", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA406: "SceneCaptureType",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
_SUB, _GPS = 0x8769, 0x8825
#: Bytes of each field type of the format.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


#: Names of the tags that a quality report shows.
QUALITY_TAGS = [
    "Make", "Model", "DateTime", "DateTimeOriginal", "DateTimeDigitized", "ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "FocalLengthIn35mmFilm", "Software", "LensModel", "LensSpecification",
    "WhiteBalance", "Flash", "ExposureMode", "ExposureProgram", "SceneCaptureType", "Orientation", "ResolutionUnit", "XResolution", "YResolution", "ColorSpace", "DigitalZoomRatio", "GPSAltitude", "GPSAltitudeRef",
    "GPSTimeStamp", "GPSDateStamp", "UserComment", "HostComputer", "Artist", "Copyright",
]


def _entries(data: bytes, order: str, at: int) -> Iterator[tuple[int, object]]:
    if at + 2 > len(data):
        return
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        here = at + 2 + 12 * k
        if here + 12 > len(data):
            return
        tag, kind, n = struct.unpack_from(order + "HHI", data, here)
        size = _SIZES.get(kind, 0) * n
        where = here + 8 if size <= 4 else struct.unpack_from(order + "I", data, here + 8)[0]
        if not size or where + size > len(data):
            continue
        raw = data[where : where + size]
        if kind == 2:
            yield tag, raw.split(b"\0")[0].decode("utf-8", "ignore").strip()
        elif kind in (5, 10):
            parts = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            yield tag, [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
        elif kind in (3, 4, 9):
            values = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw)
            yield tag, values[0] if n == 1 else list(values)
        else:
            yield tag, raw.decode("utf-8", "ignore")


def parse_exif(jpeg: bytes) -> dict[str, str]:
    """Tags by name as text, and decimal ``GPS_Lat``, ``GPS_Lon`` where both are whole. Broken data: what could be read."""
    out: dict[str, str] = {}
    try:
        at = 2
        while jpeg[:2] == b"\xff\xd8" and at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
            size = struct.unpack_from(">H", jpeg, at + 2)[0]
            if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
                data = jpeg[at + 10 : at + 2 + size]
                order = "<" if data[:2] == b"II" else ">"
                todo, gps = [(struct.unpack_from(order + "I", data, 4)[0], TAGS)], {}
                while todo:
                    where, names = todo.pop()
                    for tag, value in _entries(data, order, where):
                        if names is TAGS and tag in (_SUB, _GPS):
                            todo.append((int(value), TAGS if tag == _SUB else GPS_TAGS))
                        elif tag in names:
                            one = value[0] if isinstance(value, list) and len(value) == 1 else value
                            out[names[tag]] = str(one)
                            if names is GPS_TAGS:
                                gps[names[tag]] = value
                for axis, name in (("Latitude", "GPS_Lat"), ("Longitude", "GPS_Lon")):
                    dms = gps.get(f"GPS{axis}")
                    if isinstance(dms, list) and len(dms) == 3 and None not in dms:
                        value = dms[0] + dms[1] / 60 + dms[2] / 3600
                        out[name] = f"{-value if gps.get(f'GPS{axis}Ref') in ('S', 'W') else value:.6f}"
            at += 2 + size
    except (struct.error, IndexError, TypeError, ValueError):
        pass
    return out


def quality_tags(tags: Column) -> Column:
    """The tags a quality report shows; with both coordinates also ``GPS_Coordinates`` and links to two maps."""
    lat, lon = (F.try_element_at(tags, F.lit(k)).try_cast("double") for k in ("GPS_Lat", "GPS_Lon"))
    place = F.format_string("%.6f", lat), F.format_string("%.6f", lon)
    links = F.map_from_arrays(
        F.array(*map(F.lit, ("GPS_Coordinates", "GPS_Lat", "GPS_Lon", "Google_Maps", "OpenStreetMap"))),
        F.array(F.concat_ws(", ", *place), *place, F.concat(F.lit("https://www.google.com/maps?q="), F.concat_ws(",", *place)), map_link(lat, lon)),
    )
    shown = F.map_filter(tags, lambda k, _: k.isin(*QUALITY_TAGS))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.map_concat(shown, links)).otherwise(shown)


def exif_tags(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``exif``: a map of tags, from whole files: tags may stand behind other large segments."""
    rows = files.withColumn("_head", F.col(content)).drop(content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_head") + ", exif map<string,string>"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop(columns="_head").assign(exif=[parse_exif(bytes(b)) if b is not None else {} for b in pdf["_head"]])

    return rows.mapInPandas(each, schema)
