"""Tables of the star schema, column aliases of sources, and column orders of snapshots."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS, _D = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType(), T.DateType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, (kind, nullable) in columns.items()])


PLAY = _table(artist_name=(_S, False), album_title=(_S, True), play_time=(_TS, False), track_title=(_S, False), artist_mbid=(_S, True))
ARTIST = _table(artist_name=(_S, False), mbid=(_S, True), disambiguation_comment=(_S, True), aliases=(_S, True), country=(_S, True))
VARIANTS = _table(
    artist_variants_hash=(_S, False), artist_variants_text=(_S, False), canonical_name=(_S, False), mbid=(_S, True), to_link=(_B, True), comment=(_S, True), timestamp=(_TS, True)
)
COUNTRY = _table(iso2=(_S, False), iso3=(_S, True), en_name=(_S, False), hu_name=(_S, True))
USER_COUNTRY = _table(country_code=(_S, False), start_date=(_D, False), end_date=(_D, True))

#: Column names of sources; fixed values.
ALIASES = {
    "Artist": "artist_name",
    "Album": "album_title",
    "Song": "track_title",
    "Datetime": "play_time",
    "Timestamp": "play_time",
    "artist mbid": "artist_mbid",
    "mbid": "artist_mbid",
    "MBID": "artist_mbid",
}
PLAY_COLUMNS = [f.name for f in PLAY]
PLAY_KEYS = [["artist_name", "track_title", "play_time"], ["artist_name", "track_title"], ["artist_name"]]
