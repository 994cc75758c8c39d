"""Names of classes and predicates, which are shared by producers and queries."""

TYPE, LABEL, SAME_AS, SUBCLASS, DOMAIN, RANGE, COMMENT = "rdf:type", "rdfs:label", "owl:sameAs", "rdfs:subClassOf", "rdfs:domain", "rdfs:range", "rdfs:comment"
#: Predicates that describe the vocabulary, or classify, rather than relate entities.
STRUCTURAL = [TYPE, SUBCLASS, DOMAIN, RANGE, COMMENT]

MEME, PERSON, EVENT, SITE, SUBCULTURE = "kg:MemeEntry", "kg:PersonEntry", "kg:EventEntry", "kg:SiteEntry", "kg:SubcultureEntry"
ENTRIES = [MEME, PERSON, EVENT, SITE, SUBCULTURE]
TAG, MEME_TYPE, SERIES, STATUS, BADGE, ENTITY, INSTANCE = "kg:Tag", "kg:MemeType", "kg:Series", "kg:Status", "kg:Badge", "kg:Entity", "kg:MemeInstance"

ID, VIEWS, COMMENTS, YEAR = "kg:id", "kg:viewCount", "kg:commentCount", "kg:yearCreated"
HAS_TAG, HAS_MEME_TYPE, PART_OF_SERIES, HAS_STATUS, HAS_BADGE, MENTIONS, BELONGS_TO = "kg:hasTag", "kg:hasMemeType", "kg:partOfSeries", "kg:hasStatus", "kg:hasBadge", "kg:mentions", "kg:belongsTo"
VISION_INDEX, TEXT_INDEX, MODALITY, DATASET_TYPE, OCR_TEXT = "kg:visionIndex", "kg:textIndex", "kg:modality", "kg:datasetType", "kg:ocrText"
DATE_CREATED, TEMPORAL, BIRTH = "kg:dateCreated", "kg:temporalDescription", "kg:dateOfBirth"
EXTRACTED_BY, SOURCE = "kg:extractedBy", "kg:extractionSource"

STRING, INTEGER, GYEAR = "xsd:string", "xsd:integer", "xsd:gYear"

#: Connection predicates of an entry, with the weight by which the strongest is chosen.
CONNECTIONS = {PART_OF_SERIES: 3, HAS_TAG: 2, MENTIONS: 1}

#: Types from the most to the least preferred when a node has more than one.
TYPE_ORDER = [PERSON, EVENT, SITE, SUBCULTURE, MEME, SERIES, TAG, MEME_TYPE, STATUS, BADGE, INSTANCE, ENTITY]
