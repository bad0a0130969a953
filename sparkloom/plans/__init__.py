"""Part of sparkloom: plans."""
