"""Part of sparkloom: sources."""
