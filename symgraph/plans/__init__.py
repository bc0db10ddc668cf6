"""symgraph.plans"""
