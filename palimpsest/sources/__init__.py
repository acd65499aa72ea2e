"""Sources and adaptors: whatever yields rows of palimpsest.schemas.FILES."""
