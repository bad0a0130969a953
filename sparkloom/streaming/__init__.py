"""Part of sparkloom: streaming."""
