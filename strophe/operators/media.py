"""Choice of a published fileset by type, codec, bitrate and size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators import joins

#: Sizes that hold both testaments, and those of one. Fixed values.
BOTH = ("C", "NTOTP", "OTNTP", "NTPOTP")
ONE = {"NT": ("NT", "NTP"), "OT": ("OT", "OTP")}


def has_size(size: Column, wanted: str) -> Column:
    return size.isin(*BOTH, *ONE[wanted])


def pick_audio(filesets: DataFrame, by: Sequence[str], wanted: str, codec: str, bitrate: str, order: str, preferred: str = "") -> DataFrame:
    """One fileset for each group: the preferred type first, then audio, then audio_drama, of the codec, bitrate and size; ties to the first in order.

    filesets: type, codec, bitrate, size. The catalog's short forms "MP" and "3kbps" stand for MP3 and 64kbps.
    """
    own_codec, own_rate = F.upper("codec"), F.col("bitrate")
    known = filesets.withColumn("codec", F.when(own_codec == "MP", "MP3").otherwise(own_codec)).withColumn("bitrate", F.when(own_rate == "3kbps", "64kbps").otherwise(own_rate))
    fit = known.filter((F.col("codec") == codec) & (F.col("bitrate") == bitrate) & has_size(F.col("size"), wanted))
    types = dict.fromkeys([preferred, "audio", "audio_drama"] if preferred else ["audio", "audio_drama"])
    return joins.priority_pick(fit, by, "type", list(types), order)
