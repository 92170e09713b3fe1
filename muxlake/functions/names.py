"""Names of the codes of broadcast streams, as map literals. All values are fixed ones of the standards."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

STREAM_TYPES = {
    0x01: "MPEG-1 video", 0x02: "MPEG-2 video", 0x03: "MPEG-1 audio", 0x04: "MPEG-2 audio", 0x05: "private sections", 0x06: "private PES data",
    0x07: "MHEG", 0x08: "DSM-CC", 0x09: "H.222.1", 0x0A: "DSM-CC multiprotocol encapsulation", 0x0B: "DSM-CC U-N messages", 0x0C: "DSM-CC stream descriptors",
    0x0D: "DSM-CC sections", 0x0E: "auxiliary data", 0x0F: "AAC audio ADTS", 0x10: "MPEG-4 visual", 0x11: "AAC audio LATM", 0x12: "MPEG-4 FlexMux PES",
    0x13: "MPEG-4 FlexMux sections", 0x14: "DSM-CC synchronized download", 0x15: "metadata PES", 0x16: "metadata sections", 0x1B: "H.264 video", 0x1C: "MPEG-4 raw audio",
    0x1D: "MPEG-4 text", 0x1E: "auxiliary video", 0x1F: "SVC video", 0x20: "MVC video", 0x21: "JPEG 2000 video", 0x24: "HEVC video", 0x42: "AVS video",
    0x81: "AC-3 audio", 0x86: "SCTE-35 cues", 0x87: "E-AC-3 audio",
}
SERVICE_TYPES = {
    0x01: "digital television", 0x02: "digital radio", 0x03: "teletext", 0x04: "NVOD reference", 0x05: "NVOD time-shifted", 0x06: "mosaic", 0x07: "FM radio",
    0x08: "DVB SRM", 0x0A: "advanced codec radio", 0x0B: "advanced codec mosaic", 0x0C: "data broadcast", 0x0E: "RCS map", 0x0F: "RCS FLS", 0x10: "DVB MHP",
    0x11: "MPEG-2 HD television", 0x16: "advanced codec SD television", 0x17: "advanced codec SD NVOD time-shifted", 0x18: "advanced codec SD NVOD reference",
    0x19: "advanced codec HD television", 0x1A: "advanced codec HD NVOD time-shifted", 0x1B: "advanced codec HD NVOD reference", 0x1F: "HEVC television", 0x20: "HEVC UHD television",
}
AUDIO_TYPES = {0: "undefined", 1: "clean effects", 2: "hearing impaired", 3: "visual impaired commentary"}
RUNNING_STATUS = {0: "undefined", 1: "not running", 2: "starts in a few seconds", 3: "pausing", 4: "running", 5: "service off-air"}
TELETEXT_TYPES = {1: "initial page", 2: "subtitle page", 3: "additional information", 4: "programme schedule", 5: "subtitle for hearing impaired"}
GENRES = {
    1: "movie/drama", 2: "news/current affairs", 3: "show/game show", 4: "sports", 5: "children's/youth", 6: "music/ballet/dance", 7: "arts/culture",
    8: "social/political/economics", 9: "education/science", 10: "leisure hobbies", 11: "special characteristics",
}
LINKAGE_TYPES = {
    0x01: "information service", 0x02: "EPG service", 0x03: "CA replacement service", 0x04: "complete network or bouquet SI", 0x05: "service replacement",
    0x06: "data broadcast service", 0x07: "RCS map", 0x08: "mobile hand-over", 0x09: "system software update", 0x0A: "SSU BAT or NIT", 0x0B: "IP/MAC notification",
    0x0C: "INT BAT or NIT", 0x0D: "event linkage",
}
AIT_CONTROL = {1: "AUTOSTART", 2: "PRESENT", 3: "DESTROY", 4: "KILL", 5: "PREFETCH", 6: "REMOTE", 7: "DISABLED", 8: "PLAYBACK_AUTOSTART"}
SPLICE_COMMANDS = {0x00: "splice_null", 0x04: "splice_schedule", 0x05: "splice_insert", 0x06: "time_signal", 0x07: "bandwidth_reservation", 0xFF: "private_command"}
SEGMENTATION_TYPES = {
    0x00: "not indicated", 0x01: "content identification", 0x10: "programme start", 0x11: "programme end", 0x12: "programme early termination", 0x13: "programme breakaway",
    0x14: "programme resumption", 0x15: "programme runover planned", 0x16: "programme runover unplanned", 0x17: "programme overlap start", 0x19: "programme start in progress",
    0x20: "chapter start", 0x21: "chapter end", 0x22: "break start", 0x23: "break end", 0x30: "provider advertisement start", 0x31: "provider advertisement end",
    0x32: "distributor advertisement start", 0x33: "distributor advertisement end", 0x34: "provider placement opportunity start", 0x35: "provider placement opportunity end",
    0x36: "distributor placement opportunity start", 0x37: "distributor placement opportunity end", 0x40: "unscheduled event start", 0x41: "unscheduled event end",
    0x50: "network start", 0x51: "network end",
}
UPID_TYPES = {
    0x00: "not used", 0x01: "user defined", 0x02: "ISCI", 0x03: "Ad-ID", 0x04: "UMID", 0x05: "ISAN", 0x06: "versioned ISAN", 0x07: "TID", 0x08: "TI", 0x09: "ADI",
    0x0A: "EIDR", 0x0B: "ATSC content identifier", 0x0C: "MPU", 0x0D: "MID", 0x0E: "ADS information", 0x0F: "URI", 0x10: "UUID",
}
# Fixed values of one operator's descriptors.
CAS_PROVIDERS = {
    0x02: "CAS 3.0", 0x03: "CAS 3.0 Sib", 0x11: "CAS 2.2 / CAS 2.1", 0x14: "CAS 2.0 Sib", 0x18: "CAS 4.2", 0x19: "CAS 4.1", 0x1A: "CAS 4.0 Sib", 0x28: "CAS 5.0", 0x2C: "CAS 5.5",
}
CAS_SERVICES = {
    0x00: "simple EMM/ECM", 0x01: "Info cas old + TVMail old", 0x02: "Info banner old", 0x05: "Switch banner metadata", 0x06: "Switch banner content",
    0x09: "Info banner new metadata", 0x0A: "Info banner new content", 0x0D: "R2 control subscription", 0x10: "Info cas new", 0x11: "TVMail new metadata",
    0x12: "TVMail new data", 0x18: "ABOX",
}
UPDATE_TYPES = {0: "automatic update disabled", 1: "forced update in standby", 2: "forced update in normal mode", 3: "voluntary update in normal mode"}
VBI_SERVICES = {1: "EBU teletext", 2: "inverted teletext", 4: "VPS", 5: "WSS", 6: "closed caption", 7: "monochrome 4:2:2 samples"}
CUE_TYPES = {0: "splice_insert, splice_null, splice_schedule", 1: "all commands", 2: "segmentation", 3: "tiered splicing", 4: "tiered segmentation"}
ALIGNMENTS = {1: "slice or video access unit", 2: "video access unit", 3: "GOP or SEQ", 4: "SEQ"}
CAROUSEL_FORMATS = {0: "standard boot", 1: "enhanced boot"}
MIP_FUNCTIONS = {0: "transmitter time offset", 1: "transmitter frequency offset", 2: "transmitter power", 3: "private data", 4: "cell id", 5: "enable", 6: "bandwidth"}
HIERARCHIES = {0: "non-hierarchical", 1: "alpha 1", 2: "alpha 2", 3: "alpha 4", 4: "non-hierarchical, in-depth", 5: "alpha 1, in-depth", 6: "alpha 2, in-depth", 7: "alpha 4, in-depth"}
MIP_BANDWIDTHS = {0: "7 MHz", 1: "8 MHz", 2: "6 MHz"}
BANDWIDTHS = {0: "8 MHz", 1: "7 MHz", 2: "6 MHz", 3: "5 MHz"}
POLARIZATIONS = {0: "linear horizontal", 1: "linear vertical", 2: "circular left", 3: "circular right"}
ROLL_OFFS = {0: "0.35", 1: "0.25", 2: "0.20"}
SATELLITE_MODULATIONS = {0: "auto", 1: "QPSK", 2: "8PSK", 3: "16-QAM"}
INNER_FECS = {0: "not defined", 1: "1/2", 2: "2/3", 3: "3/4", 4: "5/6", 5: "7/8", 6: "8/9", 7: "3/5", 8: "4/5", 9: "9/10", 15: "none"}
OUTER_FECS = {0: "not defined", 1: "none", 2: "RS(204/188)"}
CABLE_MODULATIONS = {0: "not defined", 1: "16-QAM", 2: "32-QAM", 3: "64-QAM", 4: "128-QAM", 5: "256-QAM"}
T2_BANDWIDTHS = {0: "8 MHz", 1: "7 MHz", 2: "6 MHz", 3: "5 MHz", 4: "10 MHz", 5: "1.712 MHz"}
T2_GUARDS = {0: "1/32", 1: "1/16", 2: "1/8", 3: "1/4", 4: "1/128", 5: "19/128", 6: "19/256"}
T2_MODES = {0: "2k", 1: "8k", 2: "4k", 3: "1k", 4: "16k", 5: "32k"}
SISO_MISO = {0: "SISO", 1: "MISO"}
EXTENSIONS = {0x00: "image icon", 0x04: "T2 delivery system", 0x05: "SH delivery system", 0x06: "supplementary audio", 0x07: "network change notify", 0x08: "message", 0x09: "target region", 0x0A: "target region name", 0x0B: "service relocated"}
SPLICE_DESCRIPTORS = {0: "avail", 1: "DTMF", 2: "segmentation", 3: "time", 4: "audio"}
AIT_DESCRIPTORS = {0: "application", 1: "application name", 2: "transport protocol", 3: "DVB-J application", 4: "DVB-J application location", 0x10: "application storage", 0x15: "simple application location"}
STREAM_IDS = {0xBC: "program stream map", 0xBD: "private stream 1", 0xBE: "padding", 0xBF: "private stream 2", 0xF0: "ECM", 0xF1: "EMM", 0xF2: "DSM-CC", 0xF3: "ISO 13522", 0xF8: "H.222.1 type E", 0xF9: "ancillary", 0xFA: "SL-packetized", 0xFB: "FlexMux", 0xFF: "program stream directory"}
CONSTELLATIONS = {0: "QPSK", 1: "16-QAM", 2: "64-QAM"}
CODE_RATES = {0: "1/2", 1: "2/3", 2: "3/4", 3: "5/6", 4: "7/8"}
GUARD_INTERVALS = {0: "1/32", 1: "1/16", 2: "1/8", 3: "1/4"}
TRANSMISSION_MODES = {0: "2k", 1: "8k", 2: "4k"}
T2MI_TYPES = {0x00: "baseband frame", 0x01: "auxiliary stream", 0x02: "arbitrary cell insertion", 0x10: "L1 current", 0x11: "L1 future", 0x12: "P2 bias balancing", 0x20: "timestamp", 0x21: "individual addressing", 0x30: "FEF null", 0x31: "FEF I/Q", 0x32: "FEF composite", 0x33: "FEF sub-part"}


def name_of(code: Column, names: dict[int, str], other: str = "unknown") -> Column:
    """The name of a code."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(other))


def stream_id_name(code: Column) -> Column:
    """The kind of a PES stream: sound for 0xC0 to 0xDF, pictures for 0xE0 to 0xEF."""
    return F.when(code.between(0xC0, 0xDF), F.lit("audio")).when(code.between(0xE0, 0xEF), F.lit("video")).otherwise(name_of(code, STREAM_IDS))


def minimum_age(rating: Column) -> Column:
    """The age of a parental rating; null where it is undefined or the broadcaster's own."""
    return F.when(rating.between(0x01, 0x0F), rating + 3)
