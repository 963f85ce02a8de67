"""Positions out of typed text: latitude and longitude, UTM, military grid letters, on the sheets' datum or WGS 84.

The projection is Krueger's series in the third flattening, to its fourth power;
the shift between datums is a geocentric translation with Bowring's closed form
back to a latitude. All of it is Column expressions: a text becomes the array of
its readings within its row, without a shuffle or a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Datum:
    """An ellipsoid's half axes and the translation, in metres, that takes it to WGS 84."""

    name: str
    a: float
    b: float
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def n(self) -> float:
        return (self.a - self.b) / (self.a + self.b)

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2

    @property
    def meridian(self) -> float:
        """The radius of the circle that is as long as a meridian."""
        return self.a / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)


# Half axes and translations as the EPSG registry lists them.
WGS84 = Datum("wgs84", 6378137.0, 6356752.31424518)
INDIAN_1960 = Datum("indian1960", 6377304.063, 6356103.038993155, (198.0, 881.0, 317.0))
# The UTM grid's scale and false easting, and the letters of its squares and bands.
SCALE, FALSE_EASTING = 0.9996, 500_000.0
COLUMNS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")
ROWS = "ABCDEFGHJKLMNPQRSTUV"
BANDS = "CDEFGHJKLMNPQRSTUVWX"
# Where readings are believed (west, south, east, north) and the zones of a reference that names none.
WINDOW, ZONES = (101.5, 7.0, 114.0, 24.0), (48, 49)

_GRID = r"(?i)^(?:(\d{1,2})\s*([C-HJ-NP-X])?[\s,]*)?([A-Z])\s?([A-Z])[\s,]*([\d\s]{2,12})$"
_UTM = r"(?i)^(\d{1,2})\s*[C-HJ-NP-X]?[\s,]+(\d{4,7}(?:\.\d+)?)\s*E?[\s,]+(\d{4,8}(?:\.\d+)?)\s*N?$"
_ANGLE = r"""(?i)^([NSEW])?\s*(-?\d+(?:\.\d+)?)\s*°?\s*(?:(\d+(?:\.\d+)?)\s*'?\s*(?:(\d+(?:\.\d+)?)\s*"?\s*)?)?([NSEW])?$"""
_HIT = "struct<system:string,datum:string,lat:double,lng:double,ref:string,precision_m:double,west:double,south:double,east:double,north:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _series(factors: list[float], angle: Column, of: Callable[[Column], Column] = F.sin) -> Column:
    total = F.lit(0.0)
    for k, factor in enumerate(factors, 1):
        total = total + factor * of(2 * k * angle)
    return total


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def zone_of(lng: Column) -> Column:
    """Number of the UTM zone of a longitude."""
    return (F.floor((lng + 180) / 6) + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183.0


def to_utm(lng: Column, lat: Column, zone: Column, datum: Datum = WGS84) -> Column:
    """Struct of easting and northing, on the same datum; north of the equator."""
    n, e = datum.n, sqrt(datum.e2)
    factors = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    sin, off = F.sin(F.radians(lat)), F.radians(lng - central_meridian(zone))
    tan = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))

    def stretched(g: Column) -> Column:
        x, y = F.atanh(F.sin(g["off"]) / F.sqrt(1 + g["tan"] * g["tan"])), F.atan2(g["tan"], F.cos(g["off"]))
        return F.struct(x.alias("x"), y.alias("y"))

    def scaled(g: Column) -> Column:
        x, y = g["x"], g["y"]
        for k, factor in enumerate(factors, 1):
            x = x + factor * F.cos(2 * k * g["y"]) * F.sinh(2 * k * g["x"])
            y = y + factor * F.sin(2 * k * g["y"]) * F.cosh(2 * k * g["x"])
        size = SCALE * datum.meridian
        return F.struct((FALSE_EASTING + size * x).alias("easting"), (size * y).alias("northing"))

    return _let(_let(F.struct(tan.alias("tan"), off.alias("off")), stretched), scaled)


def from_utm(easting: Column, northing: Column, zone: Column, datum: Datum = WGS84) -> Column:
    """Struct of lng and lat, on the same datum; north of the equator."""
    n, size = datum.n, SCALE * datum.meridian
    factors = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    back = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]

    def plain(g: Column) -> Column:
        x, y = g["x"], g["y"]
        for k, factor in enumerate(factors, 1):
            x = x - factor * F.cos(2 * k * g["y"]) * F.sinh(2 * k * g["x"])
            y = y - factor * F.sin(2 * k * g["y"]) * F.cosh(2 * k * g["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    def conformal(g: Column) -> Column:
        return F.struct(F.asin(F.sin(g["y"]) / F.cosh(g["x"])).alias("chi"), F.atan2(F.sinh(g["x"]), F.cos(g["y"])).alias("off"))

    def point(g: Column) -> Column:
        return _point(central_meridian(zone) + F.degrees(g["off"]), F.degrees(g["chi"] + _series(back, g["chi"])))

    start = F.struct(((easting - FALSE_EASTING) / size).alias("x"), (northing / size).alias("y"))
    return _let(_let(_let(start, plain), conformal), point)


def to_wgs84(lng: Column, lat: Column, datum: Datum) -> Column:
    """Struct of lng and lat on WGS 84, eight places."""
    dx, dy, dz = datum.shift
    phi, lam, out = F.radians(lat), F.radians(lng), WGS84

    def centred(g: Column) -> Column:
        normal = datum.a / F.sqrt(1 - datum.e2 * F.pow(F.sin(g["phi"]), 2))
        around = normal * F.cos(g["phi"])
        return F.struct((around * F.cos(g["lam"]) + dx).alias("x"), (around * F.sin(g["lam"]) + dy).alias("y"), (normal * (1 - datum.e2) * F.sin(g["phi"]) + dz).alias("z"))

    def level(g: Column) -> Column:
        p = F.sqrt(g["x"] * g["x"] + g["y"] * g["y"])
        return F.struct(p.alias("p"), g["z"].alias("z"), F.atan2(g["y"], g["x"]).alias("lam"), F.atan2(g["z"] * out.a, p * out.b).alias("u"))

    def point(g: Column) -> Column:
        up = g["z"] + out.e2 / (1 - out.e2) * out.b * F.pow(F.sin(g["u"]), 3)
        phi = F.atan2(up, g["p"] - out.e2 * out.a * F.pow(F.cos(g["u"]), 3))
        return _point(F.round(F.degrees(g["lam"]), 8), F.round(F.degrees(phi), 8))

    return _let(_let(_let(F.struct(phi.alias("phi"), lam.alias("lam")), centred), level), point)


def band_of(lat: Column) -> Column:
    """Letter of a latitude's band of eight degrees."""
    return F.substring(F.lit(BANDS), (F.greatest(F.lit(0), F.least(F.lit(19), F.floor((lat + 80) / 8))) + 1).cast("int"), F.lit(1))


def _column_letters(zone: Column) -> Column:
    return F.get(F.array(*map(F.lit, COLUMNS)), (zone % 3).cast("int"))


def _row_start(zone: Column) -> Column:
    return F.when(zone % 2 == 0, 5).otherwise(0)


def square_of(easting: Column, northing: Column, zone: Column) -> Column:
    """The two letters of a 100 km square."""
    column = F.substring(_column_letters(zone), F.floor(easting / 100_000).cast("int"), F.lit(1))
    row = F.substring(F.lit(ROWS), ((F.floor(northing / 100_000) + _row_start(zone)) % 20 + 1).cast("int"), F.lit(1))
    return F.concat(column, row)


def in_window(lng: Column, lat: Column) -> Column:
    west, south, east, north = WINDOW
    return lng.between(west, east) & lat.between(south, north)


def _hit(system: Column, datum: Datum, at: Column, ref: Column, precision: Column, half: Column) -> Column:
    up = half / 111_320
    along = half / (111_320 * F.greatest(F.lit(0.2), F.cos(F.radians(at["lat"]))))
    box = ((at["lng"] - along).alias("west"), (at["lat"] - up).alias("south"), (at["lng"] + along).alias("east"), (at["lat"] + up).alias("north"))
    return F.struct(system.alias("system"), F.lit(datum.name).alias("datum"), at["lat"].alias("lat"), at["lng"].alias("lng"), ref.alias("ref"), precision.cast("double").alias("precision_m"), *box)


def _grid_hits(q: Column) -> Column:
    """Both datums' readings of grid letters or UTM, which no text is both of, that lie in their zone and in the window."""
    none = F.array().cast("array<struct<system:string,zone:int,easting:double,northing:double,band:string,rest:string,precision:double>>")
    candidates = F.concat(F.coalesce(_grid(q), none), F.coalesce(_utm(q), none))

    def read(c: Column, datum: Datum) -> Column:
        own = from_utm(c["easting"], c["northing"], c["zone"], datum)
        ref = F.concat(c["zone"].cast("string"), c["band"], F.lit(" "), c["rest"])
        near = lambda g: F.abs(g["lng"] - central_meridian(c["zone"])) <= 3.5
        shifted = lambda g: F.when(near(g), g if datum is WGS84 else to_wgs84(g["lng"], g["lat"], datum))
        hit = lambda w: F.when(in_window(w["lng"], w["lat"]), _hit(c["system"], datum, w, ref, c["precision"], F.greatest(c["precision"], F.lit(60.0))))
        return _let(_let(own, shifted), hit)

    # Northings that no latitude of the window has, with a margin, aren't projected.
    near_window = F.filter(candidates, lambda c: c["northing"].between(WINDOW[1] * 110_000 - 20_000, WINDOW[3] * 111_000 + 20_000))
    banded = F.transform(near_window, lambda c: c.withField("band", F.when(c["band"] != "", c["band"]).otherwise(_band_of_northing(c["northing"], c["zone"]))))
    both = F.transform(banded, lambda c: F.array(read(c, INDIAN_1960), read(c, WGS84)))
    return F.array_compact(F.flatten(both))


def _band_of_northing(northing: Column, zone: Column) -> Column:
    return band_of(from_utm(F.lit(FALSE_EASTING), northing, zone)["lat"])


def _grid(q: Column) -> Column:
    part = lambda k: F.upper(F.regexp_extract(q, _GRID, k))
    digits = F.regexp_replace(part(5), r"\s", "")

    def candidates(g: Column) -> Column:
        half = (F.length(g["digits"]) / 2).cast("int")
        unit = F.pow(F.lit(10.0), 5 - half)
        first, second = F.substring(g["digits"], F.lit(1), half), F.substring(g["digits"], half + 1, half)
        fits = (F.length(g["digits"]) % 2 == 0) & F.length(g["digits"]).between(2, 10)
        zones = F.when(g["zone"] != "", F.array(g["zone"].try_cast("int"))).otherwise(F.array(*map(F.lit, ZONES)))
        zones = F.filter(F.when(fits, zones).otherwise(F.array().cast("array<int>")), lambda z: z.between(1, 60))

        def of_zone(z: Column) -> Column:
            column, row = F.instr(_column_letters(z), g["column"]), F.instr(F.lit(ROWS), g["row"])
            easting = column * 100_000.0 + first.try_cast("double") * unit + unit / 2
            base = ((row - 1 - _row_start(z) + 20) % 20) * 100_000.0 + second.try_cast("double") * unit + unit / 2

            def of_cycle(c: Column) -> Column:
                northing = base + c * 2_000_000.0
                rest = F.concat(g["column"], g["row"], F.lit(" "), first, F.lit(" "), second)
                return F.struct(F.lit("mgrs").alias("system"), z.alias("zone"), easting.alias("easting"), northing.alias("northing"), g["band"].alias("band"), rest.alias("rest"), (unit / 2).alias("precision"))

            # The row letters come again after 20 squares.
            return F.when((column > 0) & (row > 0), F.transform(F.array(*map(F.lit, range(3))), of_cycle))

        return F.flatten(F.array_compact(F.transform(zones, of_zone)))

    parts = F.struct(part(1).alias("zone"), part(2).alias("band"), part(3).alias("column"), part(4).alias("row"), digits.alias("digits"))
    return F.when(F.regexp_like(q, F.lit(_GRID)), _let(parts, candidates))


def _utm(q: Column) -> Column:
    number = lambda k, kind: F.regexp_extract(q, _UTM, k).try_cast(kind)

    def candidates(g: Column) -> Column:
        whole = lambda c: F.floor(c + 0.5).cast("string")
        rest = F.concat(whole(g["easting"]), F.lit("E "), whole(g["northing"]), F.lit("N"))
        ok = g["zone"].between(1, 60) & g["easting"].between(100_000, 900_000)
        one = F.struct(F.lit("utm").alias("system"), g["zone"].alias("zone"), g["easting"].alias("easting"), g["northing"].alias("northing"), F.lit("").alias("band"), rest.alias("rest"), F.lit(30.0).alias("precision"))
        return F.array_compact(F.array(F.when(ok, one)))

    parts = F.struct(number(1, "int").alias("zone"), number(2, "double").alias("easting"), number(3, "double").alias("northing"))
    return F.when(F.regexp_like(q, F.lit(_UTM)), _let(parts, candidates))


def angle(text: Column) -> Column:
    """Struct (degrees, hemisphere or null, whether minutes or a sign were written) of one typed angle; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "[º˚∘]", "°"), "[′’`]", "'")

    def parsed(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, _ANGLE, k)
        value = lambda k: F.coalesce(part(k).try_cast("double"), F.lit(0.0))
        size = F.abs(value(2)) + value(3) / 60 + value(4) / 3600
        ok = F.regexp_like(t, F.lit(_ANGLE)) & ((part(1) == "") | (part(5) == "")) & (value(3) < 60) & (value(4) < 60)
        written = (part(3) != "") | F.regexp_like(t, F.lit("[°'\"]"))
        hemisphere = F.nullif(F.upper(F.concat(part(1), part(5))), F.lit(""))
        return F.when(ok, F.struct(F.when(value(2) < 0, -size).otherwise(size).alias("deg"), hemisphere.alias("side"), written.alias("dms")))

    return _let(F.regexp_replace(plain, "[″”]|''", '"'), parsed)


def written_angle(value: Column, sides: str, dms: Column) -> Column:
    """An angle with its side's letter, in five decimals or in degrees, minutes and seconds."""
    side, size = F.when(value < 0, sides[1]).otherwise(sides[0]), F.abs(value)
    degrees = F.floor(size)
    minutes = F.floor((size - degrees) * 60)
    seconds = F.lpad(F.format_string("%.1f", ((size - degrees) * 60 - minutes) * 60), 4, "0")
    long = F.concat(degrees.cast("string"), F.lit("°"), F.lpad(minutes.cast("string"), 2, "0"), F.lit("'"), seconds, F.lit('"'), side)
    return F.when(dms, long).otherwise(F.concat(F.format_string("%.5f", size), F.lit("°"), side))


def _lat_lng(q: Column) -> Column:
    words, comma = F.split(q, r"\s+"), F.instr(q, ",")
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    by_comma = F.when(comma > 1, pair(F.substring(q, F.lit(1), comma - 1), F.substr(q, comma + 1)))
    cuts = F.slice(F.sequence(F.lit(1), F.size(words)), F.lit(1), F.size(words) - 1)
    by_blank = F.transform(cuts, lambda k: pair(F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")))
    splits = F.array_compact(F.concat(F.array(by_comma), by_blank))

    def position(s: Column) -> Column:
        a, b = s["a"], s["b"]
        sides = a["side"].isNotNull() & b["side"].isNotNull()
        none = a["side"].isNull() & b["side"].isNull()
        a_first, b_first = a["side"].isin("N", "S"), b["side"].isin("N", "S")
        signed = lambda g, minus: F.when(g["side"] == minus, -F.abs(g["deg"])).otherwise(F.abs(g["deg"]))
        # Two bare numbers are a position only if one has a point or minutes: not a range of years.
        shown = a["dms"] | b["dms"] | s["pointed"]
        straight = (F.abs(a["deg"]) <= 90) & (F.abs(b["deg"]) <= 180)
        lat = F.when(sides & (a_first != b_first), F.when(a_first, signed(a, "S")).otherwise(signed(b, "S"))).when(none & shown, F.when(straight, a["deg"]).otherwise(b["deg"]))
        lng = F.when(sides & (a_first != b_first), F.when(a_first, signed(b, "W")).otherwise(signed(a, "W"))).when(none & shown, F.when(straight, b["deg"]).otherwise(a["deg"]))
        return F.struct(lng.alias("lng"), lat.alias("lat"), (a["dms"] | b["dms"]).alias("dms"))

    read = F.transform(splits, lambda s: F.struct(angle(s["left"]).alias("a"), angle(s["right"]).alias("b"), F.contains(F.concat(s["left"], s["right"]), F.lit(".")).alias("pointed")))
    placed = F.transform(F.filter(read, lambda s: s["a"].isNotNull() & s["b"].isNotNull()), position)
    first = F.get(F.filter(placed, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lng"]) <= 180)), F.lit(0))

    def hits(p: Column) -> Column:
        ref = F.concat(written_angle(p["lat"], "NS", p["dms"]), F.lit(" "), written_angle(p["lng"], "EW", p["dms"]))
        hit = lambda d, at: _hit(F.lit("latlon"), d, at, ref, F.lit(0.0), F.lit(120.0))
        old = _let(to_wgs84(p["lng"], p["lat"], INDIAN_1960), lambda w: hit(INDIAN_1960, w))
        # Minutes and seconds may have been read off a sheet's edge, decimals were not.
        return F.array_compact(F.array(F.when(p["lat"].isNotNull(), hit(WGS84, p)), F.when(p["dms"] & in_window(p["lng"], p["lat"]), old)))

    return F.when(first.isNotNull(), _let(first, hits))


def positions(text: Column) -> Column:
    """Every position that a text can mean, the likeliest first: an array of (system, datum, lat, lng, ref, precision_m, west, south, east, north).

    lat and lng are WGS 84, whatever datum the text was read in. A text that is
    no position, without a digit or of more than 60 characters, and a null one,
    has an empty array. A grid reference without a zone is read in every zone of
    the window; the precision is half the side of the square that it names.
    """
    none = F.array().cast(f"array<{_HIT}>")

    def first_of(q: Column, kinds: list[Callable[[Column], Column]]) -> Column:
        # A kind is only tried on a text in which those before it found nothing.
        own = F.coalesce(kinds[0](q).cast(f"array<{_HIT}>"), none)
        return own if len(kinds) == 1 else _let(own, lambda hits: F.when(F.size(hits) > 0, hits).otherwise(first_of(q, kinds[1:])))

    def read(q: Column) -> Column:
        return F.when((F.length(q) <= 60) & F.regexp_like(q, F.lit(r"\d")), first_of(q, [_grid_hits, _lat_lng])).otherwise(none)

    return F.coalesce(_let(F.regexp_replace(text, r"^\s+|\s+$", ""), read), none)
