"""The stateless projection on streams (an extension: the rest is batch)."""
