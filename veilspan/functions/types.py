"""Names of entity types: the canonical ones, their aliases and their display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical names by phase, aliases, display names.
PHASE_1 = ("PERSON_NAME", "PHONE_NUMBER", "EMAIL", "ADDRESS", "ORGANIZATION", "ID_CARD")
PHASE_2 = ("BANK_CARD", "PASSPORT", "DRIVER_LICENSE", "VEHICLE_PLATE", "IP_ADDRESS", "MAC_ADDRESS", "POSTAL_CODE", "IMEI", "VIN", "TAX_ID", "SOCIAL_SECURITY")
CANONICAL = (*PHASE_1, *PHASE_2, "MILITARY_ID")
ALIASES = {
    "DRIVERS_LICENSE": "DRIVER_LICENSE",
    "DRIVING_LICENSE": "DRIVER_LICENSE",
    "LICENSE_PLATE": "VEHICLE_PLATE",
    "CAR_PLATE": "VEHICLE_PLATE",
    "IP": "IP_ADDRESS",
    "MAC": "MAC_ADDRESS",
    "SOCIAL_SECURITY_CARD": "SOCIAL_SECURITY",
    "SOCIAL_SECURITY_NUMBER": "SOCIAL_SECURITY",
    "TAX_CARD": "TAX_ID",
    "UNIFIED_SOCIAL_CREDIT_CODE": "TAX_ID",
    "VEHICLE_VIN": "VIN",
    "VEHICLE_IDENTIFICATION_NUMBER": "VIN",
    "PHONE_IMEI": "IMEI",
    "OFFICER_CARD": "MILITARY_ID",
    "OFFICE_CARD": "MILITARY_ID",
}
DISPLAY = {
    "PERSON_NAME": "人名",
    "PHONE_NUMBER": "电话号码",
    "EMAIL": "电子邮箱",
    "ADDRESS": "地址",
    "ORGANIZATION": "组织机构",
    "ID_CARD": "身份证号",
    "BANK_CARD": "银行卡号",
    "PASSPORT": "护照号码",
    "DRIVER_LICENSE": "驾驶证号",
    "VEHICLE_PLATE": "车牌号",
    "IP_ADDRESS": "IP地址",
    "MAC_ADDRESS": "MAC地址",
    "POSTAL_CODE": "邮政编码",
    "IMEI": "手机IMEI",
    "VIN": "车辆识别码",
    "TAX_ID": "税号",
    "SOCIAL_SECURITY": "社保号",
    "MILITARY_ID": "军官证",
}
#: Names of the default recognizers' types in canonical terms, for the stages that know those only.
DETECTOR_TYPES = {
    "CHINA_ID_CARD": "ID_CARD",
    "CHINA_PHONE": "PHONE_NUMBER",
    "CHINA_BANK_CARD": "BANK_CARD",
    "CHINA_PASSPORT": "PASSPORT",
    "CREDIT_CARD": "BANK_CARD",
    "US_SSN": "SOCIAL_SECURITY",
    "EMAIL_ADDRESS": "EMAIL",
    "IP_ADDRESS_V4": "IP_ADDRESS",
    "IP_ADDRESS_V6": "IP_ADDRESS",
    "US_PHONE": "PHONE_NUMBER",
}


def literal_map(items: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in items.items() for x in pair))


def normalize_type(name: Column) -> Column:
    """Canonical and alias names in any case to the canonical name; unknown names stay as they are."""
    upper = F.upper(name)
    return F.when(upper.isin(*CANONICAL), upper).otherwise(F.coalesce(F.element_at(literal_map(ALIASES), upper), name))


def display_name(name: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(DISPLAY), normalize_type(name)), name)


def canonical_type(name: Column) -> Column:
    """A detector's type in canonical terms; an explicit step, since detectors keep their own names."""
    return F.coalesce(F.element_at(literal_map(DETECTOR_TYPES), name), normalize_type(name))
