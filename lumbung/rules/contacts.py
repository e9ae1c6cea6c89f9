"""Contact-source layouts: required headers, field mapping and precedence."""

# ---- fixed values ---------------------------------------------------------------------------
# Known file name -> (layout, source type, precedence).
KNOWN_FILES = {
    "institutions_enriched_contacts.csv": ("enriched", "institution_enriched", 5),
    "verified_cache_contacts_1640.csv": ("verified", "verified_cache", 4),
    "contact-qwen-master-clean.csv": ("crawler", "master_crawler", 3),
    "tierA_contact_enriched_v2_2026.csv": ("tier_a", "tierA_enriched", 2),
    "tierA_contact_enriched_2026.csv": ("tier_a", "tierA_enriched", 2),
}

REQUIRED_COLUMNS = {
    "enriched": ["name", "email", "current_phone", "current_whatsapp", "contact_person",
                 "position", "match_confidence", "source_url"],
    "crawler": ["institution", "kldi", "website", "email", "phone", "whatsapp", "source_url",
                "confidence_score"],
    "tier_a": ["institution_name", "kldi", "province", "research_email", "research_phone",
               "research_whatsapp", "official_website", "official_email",
               "research_source_url", "source_url", "contact_confidence"],
    "verified": ["institution_name", "cache_institution", "cache_kldi", "official_email",
                 "procurement_email", "phone", "whatsapp", "source_url", "confidence_score",
                 "verified_level", "match_status", "audit_status", "institution_type"],
}

# Canonical field -> source columns, first non-empty wins.
FIELD_SOURCES = {
    "enriched": {
        "institution_name": ["name"],
        "parent_organization": [],
        "region": ["province", "region"],
        "official_website": ["source_url"],
        "contact_email": ["email"],
        "contact_phone": ["current_phone", "manual_phone"],
        "contact_whatsapp": ["current_whatsapp", "manual_whatsapp"],
        "contact_person": ["contact_person"],
        "contact_role": ["position"],
        "contact_source_url": ["source_url"],
        "contact_notes": ["notes"],
        "confidence": ["match_confidence"],
    },
    "tier_a": {
        "institution_name": ["institution_name"],
        "parent_organization": ["kldi"],
        "region": ["province", "region"],
        "official_website": ["official_website", "source_url"],
        "contact_email": ["research_email", "official_email", "procurement_unit_email",
                          "ppid_email"],
        "contact_phone": ["research_phone", "official_phone", "procurement_unit_phone",
                          "ppid_phone"],
        "contact_whatsapp": ["research_whatsapp", "official_whatsapp"],
        "contact_person": ["research_contact_person"],
        "contact_role": ["research_position"],
        "contact_source_url": ["research_source_url", "source_url"],
        "contact_notes": ["research_notes", "evidence_notes"],
        "confidence": ["contact_confidence"],
        "confidence_percent": ["priority_score"],
    },
    "verified": {
        "institution_name": ["institution_name", "cache_institution"],
        "parent_organization": ["cache_kldi"],
        "region": ["province", "region"],
        "official_website": ["official_website", "website"],
        "contact_email": ["official_email", "procurement_email"],
        "contact_phone": ["phone"],
        "contact_whatsapp": ["whatsapp"],
        "contact_person": ["pic_name"],
        "contact_role": ["pic_title"],
        "contact_source_url": ["source_url"],
        "contact_notes": ["notes", "audit_status"],
        "confidence": ["confidence_score"],
        "endpoint_organization": ["cache_institution"],
    },
    "crawler": {
        "institution_name": ["institution", "name", "institution_name"],
        "parent_organization": ["kldi"],
        "region": ["province", "region"],
        "official_website": ["website", "official_website", "source_url"],
        "contact_email": ["email", "official_email", "procurement_email"],
        "contact_phone": ["phone", "official_phone", "procurement_unit_phone"],
        "contact_whatsapp": ["whatsapp", "official_whatsapp"],
        "contact_person": ["pic_name", "contact_person"],
        "contact_role": ["pic_position", "pic_title", "position", "department"],
        "contact_source_url": ["source_url"],
        "contact_notes": ["notes", "email_type", "phone_type"],
        "confidence": ["confidence_score"],
    },
}
HIERARCHY_LAYOUT_TYPE = "verified_cache"

CONFIDENCE_WORDS = {
    0.9: ["high", "strong", "verified_high", "likely_correct"],
    0.7: ["medium", "moderate", "verified_medium", "needs_review"],
    0.5: ["low", "weak", "verified_low"],
    0.8: ["official", "official site", "official_website"],
}

COMPLETENESS_WEIGHTS = {
    "official_website": 4.0, "contact_email": 4.0, "contact_phone": 2.0,
    "contact_whatsapp": 1.0, "contact_person": 1.0, "contact_role": 1.0,
    "contact_source_url": 1.0, "contact_notes": 1.0,
}

# Loose contact files: logical field -> accepted headers.
LOOSE_COLUMNS = {
    "institution_name": ["institution_name", "institution", "name", "contact_institution_name",
                         "cache_institution"],
    "kldi": ["kldi", "cache_kldi"],
    "website": ["website", "official_website", "source_url"],
    "email": ["email", "official_email", "procurement_email"],
    "phone": ["phone", "current_phone", "manual_phone"],
    "whatsapp": ["whatsapp", "current_whatsapp", "manual_whatsapp"],
    "pic_name": ["pic_name", "contact_person"],
    "pic_role": ["pic_role", "pic_position", "pic_title", "position"],
    "address": ["address", "alamat"],
    "source_url": ["source_url", "website", "official_website"],
    "confidence": ["confidence_score", "match_confidence", "verified_level"],
}
LOOSE_SCORED_FIELDS = ["email", "phone", "whatsapp", "website", "pic_name"]
# ---- end of fixed values --------------------------------------------------------------------
