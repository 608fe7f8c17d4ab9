"""Small tables of the standard, and the loader of the full data dictionary.

The full dictionary is a parameter: a CSV or parquet table (tag, vr, name) of the standard or of a vendor.  Built in are only
the elements that the operators themselves speak of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the standard: transfer syntaxes, (UID, name, encapsulated, file extension of a frame).
TRANSFER_SYNTAXES = [
    ("1.2.840.10008.1.2", "Implicit VR Little Endian", False, ".bin"), ("1.2.840.10008.1.2.1", "Explicit VR Little Endian", False, ".bin"),
    ("1.2.840.10008.1.2.1.98", "Encapsulated Uncompressed Explicit VR Little Endian", True, ".bin"), ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian", False, ".bin"),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian", False, ".bin"), ("1.2.840.10008.1.2.8.1", "Deflated Image Frame Compression", True, ".bin"),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline 8-bit", True, ".jpg"), ("1.2.840.10008.1.2.4.51", "JPEG Extended 12-bit", True, ".jpg"),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless Non-hierarchical", True, ".jpg"), ("1.2.840.10008.1.2.4.70", "JPEG Lossless Non-hierarchical SV1", True, ".jpg"),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless", True, ".jls"), ("1.2.840.10008.1.2.4.81", "JPEG-LS Lossy Near-lossless", True, ".jls"),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Lossless Only", True, ".jp2"), ("1.2.840.10008.1.2.4.91", "JPEG 2000", True, ".jp2"),
    ("1.2.840.10008.1.2.4.92", "JPEG 2000 Multi-component Lossless Only", True, ".jp2"), ("1.2.840.10008.1.2.4.93", "JPEG 2000 Multi-component", True, ".jp2"),
    ("1.2.840.10008.1.2.4.100", "MPEG2 Main Profile Main Level", True, ".mp2"), ("1.2.840.10008.1.2.4.101", "MPEG2 Main Profile High Level", True, ".mp2"),
    ("1.2.840.10008.1.2.4.102", "MPEG-4 AVC/H.264 High Profile", True, ".mp4"), ("1.2.840.10008.1.2.4.103", "MPEG-4 AVC/H.264 BD-compatible High Profile", True, ".mp4"),
    ("1.2.840.10008.1.2.4.107", "HEVC/H.265 Main Profile", True, ".mp4"), ("1.2.840.10008.1.2.4.108", "HEVC/H.265 Main 10 Profile", True, ".mp4"),
    ("1.2.840.10008.1.2.4.110", "JPEG XL Lossless", True, ".jxl"), ("1.2.840.10008.1.2.4.111", "JPEG XL JPEG Recompression", True, ".jxl"), ("1.2.840.10008.1.2.4.112", "JPEG XL", True, ".jxl"),
    ("1.2.840.10008.1.2.4.201", "High-Throughput JPEG 2000 Lossless Only", True, ".jph"), ("1.2.840.10008.1.2.4.202", "High-Throughput JPEG 2000 with RPCL Lossless Only", True, ".jph"),
    ("1.2.840.10008.1.2.4.203", "High-Throughput JPEG 2000", True, ".jph"), ("1.2.840.10008.1.2.5", "RLE Lossless", True, ".bin"),
]

# Fixed values of the standard: elements that the operators speak of.
ELEMENTS = {
    "00020000": ("UL", "File Meta Information Group Length"), "00020001": ("OB", "File Meta Information Version"), "00020002": ("UI", "Media Storage SOP Class UID"),
    "00020003": ("UI", "Media Storage SOP Instance UID"), "00020010": ("UI", "Transfer Syntax UID"), "00020012": ("UI", "Implementation Class UID"),
    "00080005": ("CS", "Specific Character Set"), "00080016": ("UI", "SOP Class UID"), "00080018": ("UI", "SOP Instance UID"), "00080020": ("DA", "Study Date"),
    "00080030": ("TM", "Study Time"), "00080050": ("SH", "Accession Number"), "00080060": ("CS", "Modality"), "00080080": ("LO", "Institution Name"), "00080090": ("PN", "Referring Physician's Name"),
    "00080100": ("SH", "Code Value"), "00080102": ("SH", "Coding Scheme Designator"), "00080104": ("LO", "Code Meaning"), "00080201": ("SH", "Timezone Offset From UTC"),
    "00081030": ("LO", "Study Description"), "0008103E": ("LO", "Series Description"), "00081070": ("PN", "Operators' Name"), "00100010": ("PN", "Patient's Name"), "00100020": ("LO", "Patient ID"),
    "00100030": ("DA", "Patient's Birth Date"), "00100040": ("CS", "Patient's Sex"), "00101010": ("AS", "Patient's Age"), "00104000": ("LT", "Patient Comments"), "00180050": ("DS", "Slice Thickness"),
    "0020000D": ("UI", "Study Instance UID"), "0020000E": ("UI", "Series Instance UID"), "00200011": ("IS", "Series Number"), "00200013": ("IS", "Instance Number"),
    "00280002": ("US", "Samples per Pixel"), "00280004": ("CS", "Photometric Interpretation"), "00280006": ("US", "Planar Configuration"), "00280008": ("IS", "Number of Frames"), "00280010": ("US", "Rows"),
    "00280011": ("US", "Columns"), "00280100": ("US", "Bits Allocated"), "00280101": ("US", "Bits Stored"), "00280102": ("US", "High Bit"), "00280103": ("US", "Pixel Representation"),
    "00281050": ("DS", "Window Center"), "00281051": ("DS", "Window Width"), "00281052": ("DS", "Rescale Intercept"), "00281053": ("DS", "Rescale Slope"), "003A0005": ("US", "Number of Waveform Channels"),
    "003A0010": ("UL", "Number of Waveform Samples"), "003A001A": ("DS", "Sampling Frequency"), "003A0200": ("SQ", "Channel Definition Sequence"), "003A0208": ("SQ", "Channel Source Sequence"),
    "003A0210": ("DS", "Channel Sensitivity"), "003A0211": ("SQ", "Channel Sensitivity Units Sequence"), "003A0212": ("DS", "Channel Sensitivity Correction Factor"), "00400007": ("LO", "Scheduled Procedure Step Description"),
    "00400275": ("SQ", "Request Attributes Sequence"), "0040A160": ("UT", "Text Value"), "00041130": ("CS", "File-set ID"), "00041200": ("UL", "Offset of the First Directory Record of the Root Directory Entity"),
    "00041202": ("UL", "Offset of the Last Directory Record of the Root Directory Entity"), "00041212": ("US", "File-set Consistency Flag"), "00041220": ("SQ", "Directory Record Sequence"),
    "00041400": ("UL", "Offset of the Next Directory Record"), "00041410": ("US", "Record In-use Flag"), "00041420": ("UL", "Offset of Referenced Lower-Level Directory Entity"), "00041430": ("CS", "Directory Record Type"),
    "00041500": ("CS", "Referenced File ID"), "00041510": ("UI", "Referenced SOP Class UID in File"), "00041511": ("UI", "Referenced SOP Instance UID in File"), "00041512": ("UI", "Referenced Transfer Syntax UID in File"),
    "54000100": ("SQ", "Waveform Sequence"), "54001004": ("US", "Waveform Bits Allocated"), "54001006": ("CS", "Waveform Sample Interpretation"), "54001010": ("OW", "Waveform Data"), "7FE00010": ("OW", "Pixel Data"),
}

# Fixed values of the standard: names of storage classes that archives mostly hold; others print as they are.
SOP_CLASSES = {
    "1.2.840.10008.1.3.10": "Media Storage Directory Storage", "1.2.840.10008.5.1.4.1.1.1": "Computed Radiography Image Storage", "1.2.840.10008.5.1.4.1.1.1.1": "Digital X-Ray Image Storage - For Presentation",
    "1.2.840.10008.5.1.4.1.1.1.1.1": "Digital X-Ray Image Storage - For Processing", "1.2.840.10008.5.1.4.1.1.1.2": "Digital Mammography X-Ray Image Storage - For Presentation", "1.2.840.10008.5.1.4.1.1.2": "CT Image Storage",
    "1.2.840.10008.5.1.4.1.1.2.1": "Enhanced CT Image Storage", "1.2.840.10008.5.1.4.1.1.3.1": "Ultrasound Multi-frame Image Storage", "1.2.840.10008.5.1.4.1.1.4": "MR Image Storage", "1.2.840.10008.5.1.4.1.1.4.1": "Enhanced MR Image Storage",
    "1.2.840.10008.5.1.4.1.1.6.1": "Ultrasound Image Storage", "1.2.840.10008.5.1.4.1.1.7": "Secondary Capture Image Storage", "1.2.840.10008.5.1.4.1.1.9.1.1": "12-lead ECG Waveform Storage", "1.2.840.10008.5.1.4.1.1.9.1.2": "General ECG Waveform Storage",
    "1.2.840.10008.5.1.4.1.1.9.1.3": "Ambulatory ECG Waveform Storage", "1.2.840.10008.5.1.4.1.1.9.2.1": "Hemodynamic Waveform Storage", "1.2.840.10008.5.1.4.1.1.12.1": "X-Ray Angiographic Image Storage",
    "1.2.840.10008.5.1.4.1.1.12.2": "X-Ray Radiofluoroscopic Image Storage", "1.2.840.10008.5.1.4.1.1.20": "Nuclear Medicine Image Storage", "1.2.840.10008.5.1.4.1.1.66.4": "Segmentation Storage",
    "1.2.840.10008.5.1.4.1.1.88.11": "Basic Text SR Storage", "1.2.840.10008.5.1.4.1.1.88.22": "Enhanced SR Storage", "1.2.840.10008.5.1.4.1.1.88.33": "Comprehensive SR Storage", "1.2.840.10008.5.1.4.1.1.104.1": "Encapsulated PDF Storage",
    "1.2.840.10008.5.1.4.1.1.128": "Positron Emission Tomography Image Storage", "1.2.840.10008.5.1.4.1.1.481.1": "RT Image Storage", "1.2.840.10008.5.1.4.1.1.481.2": "RT Dose Storage", "1.2.840.10008.5.1.4.1.1.481.3": "RT Structure Set Storage",
    "1.2.840.10008.5.1.4.1.1.481.5": "RT Plan Storage",
}

# Fixed values of the standard: meanings of code strings, by tag.
CODE_STRINGS = {
    "00080064": {"DV": "Digitized Video", "DI": "Digital Interface", "DF": "Digitized Film", "WSD": "Workstation", "SD": "Scanned Document", "SI": "Scanned Image", "DRW": "Drawing", "SYN": "Synthetic Image"},
    "00180020": {"SE": "Spin Echo", "IR": "Inversion Recovery", "GR": "Gradient Recalled", "EP": "Echo Planar", "RM": "Research Mode"},
    "00180021": {"SK": "Segmented k-space", "MTC": "Magnetization transfer contrast", "SS": "Steady state", "TRSS": "Time reversed steady state", "SP": "Spoiled", "MP": "MAG prepared", "OSP": "Oversampling phase", "NONE": "No sequence variant"},
    "00181140": {"CW": "Clockwise", "CC": "Counter clockwise"},
    "00181181": {"PARA": "Parallel (default)", "PINH": "Pinhole", "FANB": "Fan-beam", "CONE": "Cone-beam", "SLNT": "Slant hole", "ASTG": "Astigmatic", "DIVG": "Diverging", "NONE": "No collimator", "UNKN": "Unknown"},
    "00185100": {
        "HFP": "Head First-Prone", "HFS": "Head First-Supine", "HFDR": "Head First-Decubitus Right", "HFDL": "Head First-Decubitus Left", "FFDR": "Feet First-Decubitus Right", "FFDL": "Feet First-Decubitus Left",
        "FFP": "Feet First-Prone", "FFS": "Feet First-Supine",
    },
    "00185101": {"AP": "Anterior/Posterior", "PA": "Posterior/Anterior", "LL": "Left Lateral", "RL": "Right Lateral", "RLD": "Right Lateral Decubitus", "LLD": "Left Lateral Decubitus", "RLO": "Right Lateral Oblique", "LLO": "Left Lateral Oblique"},
    "00200062": {"R": "Right", "L": "Left", "U": "Unpaired", "B": "Both left and right"},
    "00281040": {"LIN": "Approximately proportional to X-Ray beam intensity", "LOG": "Non-linear \"Log Function\"", "OTHER": "Not proportional to X-Ray beam intensity"},
    "00282110": {"00": "Image has not been subjected to lossy compression", "01": "Image has been subjected to lossy compression"},
    "00080060": {
        "AU": "Audio", "DOC": "Document", "EEG": "Electroencephalography", "HD": "Hemodynamic Waveform", "IVUS": "Intravascular Ultrasound", "KO": "Key Object Selection", "OP": "Ophthalmic Photography", "PR": "Presentation State",
        "PX": "Panoramic X-Ray", "REG": "Registration", "RESP": "Respiratory Waveform", "SM": "Slide Microscopy", "TG": "Thermography", "XC": "External-camera Photography",
        "CR": "Computed Radiography", "CT": "Computed Tomography", "DX": "Digital Radiography", "ECG": "Electrocardiography", "ES": "Endoscopy", "MG": "Mammography", "MR": "Magnetic Resonance",
        "NM": "Nuclear Medicine", "OT": "Other", "PT": "Positron emission tomography (PET)", "RF": "Radio Fluoroscopy", "RTDOSE": "Radiotherapy Dose", "RTIMAGE": "Radiotherapy Image", "RTPLAN": "Radiotherapy Plan",
        "RTSTRUCT": "Radiotherapy Structure Set", "SC": "Secondary Capture", "SEG": "Segmentation", "SR": "SR Document", "US": "Ultrasound", "XA": "X-Ray Angiography",
    },
    "00100040": {"M": "Male", "F": "Female", "O": "Other"},
}


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    """(uid, name, encapsulated, extension): constant."""
    return spark.createDataFrame(TRANSFER_SYNTAXES, "uid string, name string, encapsulated boolean, extension string")


def dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(tag, vr, name): the built-in elements, and those of a table or CSV file, which win."""
    own = spark.createDataFrame([(t, vr, n) for t, (vr, n) in ELEMENTS.items()], "tag string, vr string, name string")
    if path is None:
        return own
    read = spark.read.csv(path, header=True, schema="tag string, vr string, name string") if path.endswith(".csv") else spark.read.parquet(path)
    more = read.select(F.upper("tag").alias("tag"), "vr", "name")
    return more.unionByName(own.join(more, "tag", "left_anti"))


def vr_of(dictionary_rows: DataFrame) -> dict[int, str]:
    """Value representations by tag for the reader of implicit files; a dictionary has a few thousand rows."""
    return {int(r.tag, 16): r.vr for r in dictionary_rows.where("tag rlike '^[0-9A-F]{8}$'").collect()}


def named(value: Column, table: dict[str, str]) -> Column:
    """The meaning of a value, or the value itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), value), value)


def uid_named(value: Column) -> Column:
    return named(value, {u: n for u, n, _, _ in TRANSFER_SYNTAXES} | SOP_CLASSES)


def code_described(tag: str, value: Column) -> Column:
    return named(value, CODE_STRINGS[tag]) if tag in CODE_STRINGS else value


def frame_extension(syntax: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for u, _, _, e in TRANSFER_SYNTAXES for x in (u, e)]), syntax), F.lit(".bin"))
