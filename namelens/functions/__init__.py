"""Part of the identity-matching library."""
