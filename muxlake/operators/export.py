"""What other programs read: splice cues as XML, and rows as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions.names import SPLICE_COMMANDS, name_of
from muxlake.operators import descriptors as desc

# Namespace, element and attribute names of the schema of SCTE 35.
NAMESPACE = "http://www.scte.org/schemas/35"


def splice_xml(cues: DataFrame) -> DataFrame:
    """cues of tables.splice with a column xml: one SpliceInfoSection each, its command as an element of its own."""
    present = lambda c, name: F.col(c).alias(f"_{name}")
    time = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("_ptsTime")))
    insert = F.struct(
        present("event_id", "spliceEventId"), present("cancelled", "spliceEventCancelIndicator"), present("out_of_network", "outOfNetworkIndicator"),
        present("immediate", "spliceImmediateFlag"), present("unique_program_id", "uniqueProgramId"), present("avail", "availNum"), present("avails_expected", "availsExpected"),
        F.when(F.col("splice_pts").isNotNull(), F.struct(time("splice_pts").alias("SpliceTime"))).alias("Program"),
        F.when(F.col("break_duration").isNotNull(), F.struct(present("auto_return", "autoReturn"), present("break_duration", "duration"))).alias("BreakDuration"),
    )
    signal = F.struct(time("splice_pts").alias("SpliceTime"))
    event = lambda e: F.struct(
        e["event_id"].alias("_spliceEventId"), e["cancelled"].alias("_spliceEventCancelIndicator"), e["out_of_network"].alias("_outOfNetworkIndicator"),
        e["unique_program_id"].alias("_uniqueProgramId"), e["avail"].alias("_availNum"), e["avails_expected"].alias("_availsExpected"),
        F.when(e["utc_splice_time"].isNotNull(), F.struct(e["utc_splice_time"].alias("_utcSpliceTime"))).alias("Program"),
        F.when(e["break_duration"].isNotNull(), F.struct(e["auto_return"].alias("_autoReturn"), e["break_duration"].alias("_duration"))).alias("BreakDuration"),
    )
    schedule = F.struct(F.transform("schedule", event).alias("Event"))
    private = F.struct(present("private_identifier", "identifier"), F.hex("private_bytes").alias("PrivateBytes"))
    section = F.struct(
        F.lit(NAMESPACE).alias("_xmlns"), present("protocol", "protocolVersion"), present("pts_adjustment", "ptsAdjustment"), present("tier", "tier"),
        F.when(F.col("command_type") == 5, insert).alias("SpliceInsert"), F.when(F.col("command_type") == 6, signal).alias("TimeSignal"),
        F.when(F.col("command_type") == 4, schedule).alias("SpliceSchedule"), F.when(F.col("command_type") == 0xFF, private).alias("PrivateCommand"),
        F.when(~F.col("command_type").isin(4, 5, 6, 0xFF), F.struct(name_of(F.col("command_type"), SPLICE_COMMANDS).alias("_name"))).alias("SpliceCommand"),
    )
    return cues.withColumn("xml", F.to_xml(section, {"rowTag": "SpliceInfoSection"}))


def segmentation_xml(found: DataFrame) -> DataFrame:
    """Rows of descriptors.segmentations with a column xml: one SegmentationDescriptor each."""
    present = lambda c, name: F.col(c).alias(f"_{name}")
    limits = F.struct(
        present("web_allowed", "webDeliveryAllowedFlag"), present("no_regional_blackout", "noRegionalBlackoutFlag"), present("archive_allowed", "archiveAllowedFlag"),
        present("device_restrictions", "deviceRestrictions"),
    )
    upid = F.struct(present("upid_type", "segmentationUpidType"), F.hex("upid").alias("_VALUE"))
    element = F.struct(
        F.lit(NAMESPACE).alias("_xmlns"), present("event_id", "segmentationEventId"), present("cancelled", "segmentationEventCancelIndicator"), present("duration", "segmentationDuration"),
        present("type_id", "segmentationTypeId"), present("segment", "segmentNum"), present("segments", "segmentsExpected"),
        F.when(F.col("web_allowed").isNotNull(), limits).alias("DeliveryRestrictions"), F.when(F.col("upid_type").isNotNull(), upid).alias("SegmentationUpid"),
    )
    return found.withColumn("xml", F.to_xml(element, {"rowTag": "SegmentationDescriptor"}))


_PLACE = ["source", "pid", "first_offset", "place"]


def descriptor_xml(descriptors: DataFrame) -> DataFrame:
    """Rows of descriptors.split of family splice with a column xml: an element of each kind, private ones for tags that the schema does not name."""
    present = lambda c, name: F.col(c).alias(f"_{name}")
    kinds = {
        0x00: ("AvailDescriptor", [present("provider_avail_id", "providerAvailId")]),
        0x01: ("DTMFDescriptor", [present("preroll", "preroll"), present("dtmf_chars", "chars")]),
        0x03: ("TimeDescriptor", [present("tai_seconds", "taiSeconds"), present("tai_ns", "taiNs"), present("utc_offset", "utcOffset")]),
        0x04: ("AudioDescriptor", [F.transform("channels", lambda c: F.struct(
            c["component_tag"].alias("_componentTag"), c["language"].alias("_ISOCode"), c["bit_stream_mode"].alias("_BitStreamMode"), c["n_channels"].alias("_NumChannels"), c["full_service"].alias("_FullSrvcAudio"),
        )).alias("AudioChannel")]),
    }
    own = descriptors.columns
    out = [segmentation_xml(desc.typed(descriptors, "splice", 0x02)).select(*own, F.replace("xml", F.lit(f' xmlns="{NAMESPACE}"'), F.lit("")).alias("xml"))]
    for tag, (element, fields) in kinds.items():
        out.append(desc.typed(descriptors, "splice", tag).select(*own, F.to_xml(F.struct(*fields), {"rowTag": element}).alias("xml")))
    other = desc.splice_other(descriptors.where(~F.col("tag").isin(0x02, *kinds)))
    private = F.struct(F.col("tag").alias("_privateTag"), F.col("identifier").alias("_identifier"), F.hex("private_bytes").alias("PrivateBytes"))
    out.append(other.select(*own, F.to_xml(private, {"rowTag": "PrivateDescriptor"}).alias("xml")))
    return reduce(DataFrame.union, out)


def full_end_tags(xml: Column) -> Column:
    """XML whose empty elements have end tags of their own."""
    return F.regexp_replace(xml, r"<([\w:.-]+)((?:\s+[\w:.-]+=\"[^\"]*\")*)\s*/>", "<$1$2></$1>")


def cue_documents(cues: DataFrame) -> DataFrame:
    """cues of tables.splice with a column xml: one document each, the descriptors behind the command in their order, every element with an end tag."""
    found = descriptor_xml(desc.split(cues.select(*_PLACE, "descriptors"), "descriptors", "splice"))
    listed = found.groupBy(*_PLACE).agg(F.sort_array(F.collect_list(F.struct("position", "xml"))).getField("xml").alias("_inner"))
    whole = splice_xml(cues).join(listed, _PLACE, "left")
    end = "</SpliceInfoSection>"
    full = full_end_tags(F.col("xml"))
    body = F.substring(full, F.lit(1), F.length(full) - len(end))
    inner = full_end_tags(F.array_join(F.coalesce("_inner", F.array().cast("array<string>")), "\n"))
    return whole.select(*cues.columns, F.concat(body, inner, F.lit(end)).alias("xml"))


def as_json(df: DataFrame) -> DataFrame:
    """A column of JSON for each row; binary fields in base64."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
