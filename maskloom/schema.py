"""Names and types of what the engine finds."""

from __future__ import annotations

#: Entity types in their order, with the key policies use for each
#: and the tag that placeholders show.
ENTITY_TYPES = (
    ("Person", "person", "PERSON"),
    ("Email", "email", "EMAIL"),
    ("Phone", "phone", "PHONE"),
    ("Address", "address", "ADDRESS"),
    ("Postcode", "postcode", "POSTCODE"),
    ("EmployeeId", "employee-id", "EMPLOYEE_ID"),
    ("CustomerId", "customer-id", "CUSTOMER_ID"),
    ("AccountId", "account-id", "ACCOUNT_ID"),
    ("Iban", "iban", "IBAN"),
    ("SortCode", "sort-code", "SORT_CODE"),
    ("InternalIp", "internal-ip", "INTERNAL_IP"),
    ("Hostname", "hostname", "HOSTNAME"),
    ("ApiKey", "api-key", "API_KEY"),
    ("TraceId", "trace-id", "TRACE_ID"),
    ("Password", "password", "PASSWORD"),
    ("PrivateKey", "private-key", "PRIVATE_KEY"),
    ("Secret", "secret", "SECRET"),
    ("AccessToken", "access-token", "ACCESS_TOKEN"),
)
#: A custom type is written ``Custom:<name>``; it comes after the fixed ones.
CUSTOM = "Custom:"
CUSTOM_TAG = "CUSTOM"
ORDER = {name: i for i, (name, _, _) in enumerate(ENTITY_TYPES)}
POLICY_KEYS = {name: key for name, key, _ in ENTITY_TYPES}
TAGS = {name: tag for name, _, tag in ENTITY_TYPES}

FINDING = "struct<entity_type:string,type_ord:int,start:int,end:int,confidence:float,detector:string,value:string>"
MASK, REDACT, BLOCK, PASS = "mask", "irreversible-redact", "block", "pass"
#: Destinations to which nothing is ever restored, whatever a policy says.
HARD_DENY = ("remote-model-prompt", "observability-sink")
DESTINATIONS = (*HARD_DENY, "local-patch", "local-test-fixture", "local-explanation-buffer")
