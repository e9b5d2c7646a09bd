"""The rules that find identifiers in text."""

from __future__ import annotations

DIGITS = None  # hint of rules that any digit may start

#: Type, pattern, group that is the identifier (0: the whole match), confidence, words of which one must occur.
RULES = (
    ("SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", 0, 0.99, DIGITS),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b", 0, 0.99, ("@",)),
    ("FAX", r"(?i)\b(?:fax[:\s]+)((?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4})\b", 1, 0.98, ("fax",)),
    ("PROVIDER_ID", r"(?i)\b(?:NPI:?\s*)(\d{10})\b", 1, 0.99, ("npi",)),
    ("PHONE", r"(?i)\b(?:phone(?:/cell)?(?:\s*no\.?)?|cell|mobile|tel(?:ephone)?)[: \t#.]*(\+?[0-9 \t().-]{7,16})\b", 1, 0.98, DIGITS),
    ("PHONE", r"\b(?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}\b", 0, 0.96, DIGITS),
    ("PHONE", r"\b(?:\+?91[-. ]?)?[6-9]\d{9}\b", 0, 0.95, DIGITS),
    ("HEALTH_PLAN_ID", r"(?i)\b(?:Health\s*Plan|Member\s*ID|Policy)[:\s#]+([A-Z]{2,4}\d{6,12})\b", 1, 0.98, ("health", "member", "policy")),
    ("MRN", r"(?i)\b(?:MRN:?\s*|Record:?\s*)([0-9]{4,5}-[0-9]{4,5}-[A-Z0-9]{2,4})\b", 1, 0.98, DIGITS),
    ("MRN", r"(?i)\b(?:PATIENT\s*ID|PID|UHID)\s*[:.]?\s*([A-Za-z0-9-]{6,20})\b", 1, 0.98, ("patient", "pid", "uhid")),
    ("MRN", r"(?i)\b([A-Z]{2,4}\d{6,12})\s*PATIENT\s*ID\b", 1, 0.98, ("patient",)),
    ("MRN", r"(?i)\b(?:LAB\s*NO\.?|TEST\s*NO\.?)\s*[:.]?\s*([A-Za-z0-9-]{6,20})\b", 1, 0.98, ("lab", "test")),
    ("MRN", r"(?i)\b(?:ACCESSION\s*(?:NO\.?|ID)?)\s*[:.]?\s*(\d{6,12}|[A-Za-z0-9-]{6,20}?)(?=\s*WARD|\s*:|\b)", 1, 0.98, ("accession",)),
    ("ACCOUNT", r"(?i)\b(?:Account|Acct)[:\s#]+([A-Za-z0-9-]{6,18})\b", 1, 0.95, ("acc",)),
    ("LICENSE", r"(?i)\b(?:License|Lic)(?:\s*#)?[:\s#]+([A-Za-z0-9-]{6,18})\b", 1, 0.95, ("lic",)),
    ("VEHICLE_ID", r"\b(?:[A-HJ-NPR-Z0-9]{17}|(?:VIN|Plate)[:\s]+[A-Za-z0-9-]{5,10})\b", 0, 0.95, DIGITS),
    ("DEVICE_ID", r"(?i)\b(?:Device|Serial|IMEI)[:\s]+([A-Za-z0-9-]{8,20})\b", 1, 0.95, ("device", "serial", "imei")),
    ("URL", r"\bhttps?://[^\s/$.?#].[^\s]*|\bwww\.[^\s/$.?#].[^\s]*\b", 0, 0.99, ("http", "www.")),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", 0, 0.99, (".", ":")),
    ("BIOMETRIC_REF", r"(?i)\b(?:fingerprint|voiceprint|retina\s*scan|iris\s*scan)[:\s]+([A-Za-z0-9_-]{6,32})\b", 1, 0.95, ("fingerprint", "voiceprint", "scan")),
    ("FINANCIAL", r"\b(?:[A-Z]{2}\d{2}[A-Z0-9]{12,30}|(?:[\$€£]|USD\s*|EUR\s*)?\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4})\b", 0, 0.95, DIGITS),
    ("DATE", r"(?i)\b(?:AGE(?:/SEX)?|Age)\s*[:.]?\s*(\d{1,3}\s*(?:Y(?:ears?)?|Yrs?|M(?:onths?)?)?(?:\s*/\s*[MFmf])?)\b", 1, 0.96, ("age",)),
    ("DATE", r"\b\d{1,3}\s*(?:Y/F|Y/M|Yrs?|Years?)\b", 0, 0.95, DIGITS),
    ("DATE", r"\b\d{1,3}-year-old\s+(?:female|male|boy|girl|man|woman|patient)\b", 0, 0.95, ("year-old",)),
    ("DATE", r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})(?:\s*[-–@,]?\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?)?\b", 0, 0.92, DIGITS),
    ("ADDRESS", r"(?i)\b(?:SAMPLE\s*COLLECTED\s*AT|COLLECTED\s*AT)\s*[:.]?\s*([A-Za-z0-9\s.,&-]+?)(?=\s*:|\n|$)", 1, 0.92, ("collected",)),
    ("ADDRESS", r"(?i)\b(?:REFERRED\s*BY)\s*[:.]?\s*([A-Za-z0-9\s.,&-]+?)(?=\s*:|\n|$)", 1, 0.92, ("referred",)),
    ("ADDRESS", r"(?i)(?:^|[\n:])\s*([A-Z0-9\s.,&-]{3,30}?)\s+(?:REPORTING\s*DATE|COLLECTION\s*DATE)", 1, 0.90, ("date",)),
    ("ADDRESS", r"(?i)\b\d{1,5}\s+[A-Za-z0-9\s.,]+?\b(?:Street|St|Avenue|Ave|Terrace|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Way)\b(?:[,\s]+[A-Za-z\s]+[,\s]+[A-Z]{2}\s+\d{5})?", 0, 0.90, DIGITS),
    ("NAME", r"(?i)\b(?:Miss|Mr|Mrs|Ms|Master|Mast|Dr|DR|Doctor|Prof|Professor|Shri|Smt)\.?\s+([A-Za-z]{2,}(?:[ \t]+(?!at\b|in\b|on\b|to\b|from\b|by\b|with\b|and\b|or\b)[A-Za-z]{2,}){0,3})\b", 0, 0.96, ("dr", "mr", "ms", "miss", "prof", "shri", "smt")),
    ("NAME", r"(?i)(?:Patient\s*Name|Patient|:\s*Name|Name\s*:|Attending(?:\s*Physician)?|Emergency\s*Contact|Physician)\s*[:.]?\s*(?:Miss|Mr|Mrs|Ms|Dr|DR)?\.?\s*([A-Za-z]{2,}(?:[ \t]+(?!at\b|in\b|on\b|to\b|from\b|by\b|with\b|and\b|or\b)[A-Za-z]{2,}){0,3})\b", 1, 0.94, ("name", "patient", "attending", "emergency", "physician")),
    ("NAME", r"(?i)\b(?:Printed\s*By|Operator|Technician|Verified\s*By)\s*[:.]?\s*([A-Za-z0-9_-]{3,20})\b", 1, 0.92, ("printed", "operator", "technician", "verified")),
    ("NAME", r"(?i)\b([A-Za-z0-9_-]{3,20})(?:\s*Printed\s*By)\b", 1, 0.92, ("printed",)),
)
